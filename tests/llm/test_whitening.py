import math
from collections import Counter

import numpy as np
import pytest
from freightcube.llm import queries, whitening
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def whole(vectors, dims):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for v in vectors]


def check(rows, kept, components):
    """``rows`` of the query against a dense eigendecomposition of the vectors ``kept`` (id, vector)."""
    dims = max(len(v) for _, v in kept)
    x = whole([v for _, v in kept], dims)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], object)
    xc = exact.astype(float) / n
    cov = xc.T @ xc / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = xc @ vectors / np.sqrt(values)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert Counter(r["vec_id"] for r in rows) == Counter({k: m * components for k, m in Counter(i for i, _ in kept).items()})
    got = np.full((n, components), np.nan)
    for at, (i, _) in enumerate(kept):  # ids are distinct where values are compared
        for r in by_id[i]:
            got[at, r["component"] - 1] = r["whitened"]
            assert r["n"] == n
            if len(by_id[i]) == components:
                assert r["deviation"] == int((exact[at] ** 2).sum())
            assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-9
            assert 0 <= r["identity_error"] < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    gaps = np.abs(np.diff(values)) > 1e-3 * values[0]
    apart = np.concatenate((gaps, [True])) & np.concatenate(([True], gaps))
    assert np.abs(got * signs - want)[:, apart].max() < 1e-6
    identity = got.T @ got / n - np.eye(components)
    assert np.abs(identity).max() < 1e-9


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}")


def test_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, SF).collect()
    check(rows, [(r["vec_id"], r["embedding"]) for r in vectors], 32)


@pytest.mark.parametrize("n, dims, power", [(400, 100, 0.5), (300, 80, 2.0), (200, 10, 1.0), (25, 60, 0.3)])
def test_spectra(spark, n, dims, power):
    draw = np.random.default_rng(n)
    scales = np.arange(1, dims + 1) ** -power * 30
    turn = np.linalg.qr(draw.standard_normal((dims, dims)))[0]
    x = (draw.standard_normal((n, dims)) * scales @ turn + 5).astype(np.float32)
    rows = queries.whitened_rows(frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])).collect()
    check(rows, [(i, r) for i, r in enumerate(x)], min(32, dims, n - 1))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    usable = [(i, [float(v) for v in draw.standard_normal(6)]) for i in range(40)] + [(50, [1.0, 2.0]), (51, [])]
    odd = [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (62, [float("nan")] * 6), (63, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = queries.whitened_rows(frame(spark, usable + odd)).collect()
    check(rows, usable, 6)
    wide = frame(spark, usable + odd).select("*", *[F.lit("x").alias(c) for c in ("vector", "ids", "body", "n", "component", "whitened", "a b")])
    check(queries.whitened_rows(wide).collect(), usable, 6)
    repeated = usable + usable[:1] * 9 + [(None, usable[1][1])] * 2
    got = queries.whitened_rows(frame(spark, repeated)).collect()
    assert len(got) == 6 * len(repeated) and {r["n"] for r in got} == {len(repeated)}
    assert sum(r["vec_id"] is None for r in got) == 12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    df = queries.whitened_rows(frame(spark, rows))
    assert df.collect() == []
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 5.0]), (3, [2.0, -3.0])]
    got = queries.whitened_rows(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and all(math.isfinite(r["whitened"]) for r in got)
    assert {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


def test_passes_filter_the_spectrum():
    """The polynomial is at most as large on the unwanted end as a hundredth of what it is above."""
    values = np.concatenate((np.linspace(1.5, 3, 10), np.linspace(0, 1, 30)))
    q = np.eye(40)
    out = np.abs(np.diag(whitening.filtered(lambda y: values[:, None] * y, q, values[:, None] * q, 1.0, 3.0, 8)))
    assert out[10:].max() < 0.01 * out[:10].min()
