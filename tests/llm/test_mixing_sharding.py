import zlib
from collections import defaultdict

import duckdb
import pytest
from freightcube.llm import mixing, queries, sharding
from freightcube.llm.common import saved
from freightcube.llm.mixing import mix_sources
from freightcube.llm.sharding import shard_by_bytes

SF = "/root/testdata/sf0.01"


def fill(sizes, weights, most):
    """Shares by weight, the excess over ``most`` shared again until none is above."""
    total, left = sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        share = (total - sum(out[i] for i in range(len(sizes)) if i not in left)) / sum(weights[i] for i in left)
        over = {i for i in left if share * weights[i] > most * sizes[i]}
        for i in over or left:
            out[i] = float(most * sizes[i]) if over else share * weights[i]
        left = left - over if over else set()
    return out


def mix(spark, rows, schema="doc_id long, text string, source string, target string"):
    return mix_sources(spark.createDataFrame(rows, schema)).collect()


def test_targets_and_cuts(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i % 7), s, "x") for i, s in enumerate(["a"] * 60 + ["b"] * 9 + ["é"] * 2 + [None] * 5)]
    rows += [(100, None, "b", "x"), (101, "", "a", "x"), (102, " \t\n", "zero", "x"), (7, words(1), "a", "x"), (7, words(1), "a", "x")]
    got = mix(spark, rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = fill(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], 3)
    for s, size, target in zip(names, sizes, want):
        assert {r["source_size"] for r in by[s]} == {size}
        assert all(abs(r["target"] - target) < 1e-6 for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) < 1
        if size:
            epochs = int(by[s][0]["target"]) // size
            ordered = sorted(by[s], key=lambda r: (r["key"], r["doc_id"], r["size"]))
            rest = int(by[s][0]["target"]) - epochs * size
            for r in ordered:
                assert r["taken"] == epochs * r["size"] + min(r["size"], rest)
                rest -= min(r["size"], rest)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_rows_of_one_key_are_divided(spark, monkeypatch):
    """Most rows of a source have no id, and many of them one text."""
    tables = {}
    monkeypatch.setattr(mixing, "saved", lambda df, name: tables.setdefault(name, saved(df, name)))
    rows = [(i if i < 100 else None, " ".join(["w"] * (1 + (i % 9 if i < 1200 else 4))), s, "x") for s in ("a", "b", None) for i in range(2000)]
    got = mix(spark, rows)
    for s, n in (("a", 1), ("b", 2), (None, 3)):
        ordered = sorted((r for r in got if r["source"] == s), key=lambda r: (r["key"], r["size"], -r["taken"]))
        size = sum(r["size"] for r in ordered)
        budget = int(ordered[0]["target"])
        epochs, rest = divmod(budget, size)
        assert sum(r["taken"] for r in ordered) == budget and len(ordered) == 2000
        for r in ordered:
            assert r["taken"] == epochs * r["size"] + min(r["size"], rest)
            rest -= min(r["size"], rest)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fullest = max(r["count"] for r in tables["mix-ranges"].groupBy("name", "unnamed", "key_range").count().collect())
    assert fullest <= 2 * len(rows) / parts  # one key has 1,900 rows in each source


def test_mix_degenerate(spark):
    assert mix(spark, []) == []
    assert [r["taken"] for r in mix(spark, [(1, None, None, "x")])] == [0]
    assert [r["taken"] for r in mix(spark, [(None, "a b", "s", "x"), (None, "a b", "s", "x")])] == [2, 2]
    assert sorted(map(tuple, mix(spark, [(1, "a b c", "s", "x")]))) == sorted(map(tuple, mix(spark, [(1, "a b c", "s", "x")])))


def shards(spark, rows, **how):
    return shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard string"), **how).collect()


@pytest.mark.parametrize("how", [{}, {"min_ranges": 2, "samples_per_range": 1, "overfull": 1.1}])
def test_shards(spark, how):
    rows = [(i, "é" * (i * 37 % 400), "x") for i in range(700)] + [(1000 + i, "copy of a text" * 9, "x") for i in range(400)] + [(5000, None, "x")]
    got = shards(spark, rows, **how)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert sorted(by) == list(range(8)) and len(got) == len(rows)
    for shard in by.values():
        assert abs(sum(r["size"] for r in shard) - total / 8) <= most
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}


def test_shard_sample_is_bounded_by_keys(spark):
    """Rows repeated in full come to the driver once, with the weight of them all."""
    frame = spark.createDataFrame([(t, -1, 10) for t in range(8) for _ in range(400)] + [(100 + i, i, 10) for i in range(400)],
                                  "text_hash long, order_id long, size long")
    for rate in (0.0005, 0.01):  # 18 and 360 keys due of 36,000 bytes; a repeated key is due 2 and 40 times
        drawn = sharding._drawn(frame, rate).collect()
        assert {(r[0], r[2]) for r in drawn if r[1] == -1} == {(t, 4000 * rate) for t in range(8)}
        assert len(drawn) <= 8 + 3 * 4000 * rate + 5 and all(r[2] == 1 for r in drawn if r[1] >= 0)
    assert sharding._splitters([((1, 0), 1.0), ((2, 0), 6.0), ((3, 0), 1.0)], 4) == [(2, 0), ]
    assert sharding._splitters([((i, 0), 1.0) for i in range(8)], 4) == [(2, 0), (4, 0), (6, 0)]


def test_shards_degenerate(spark):
    assert shards(spark, []) == []
    got = shards(spark, [(None, None, "x"), (None, None, "x"), (3, "a", "x")])
    assert len(got) == 3 and all(0 <= r["shard"] < 8 and r["slot"] >= 0 for r in got)


def test_shard_query(spark):
    got = queries.op6_sharding(spark, SF).collect()
    n, total, most = duckdb.sql(f"SELECT count(*), sum(strlen(text) + 1), max(strlen(text) + 1) FROM '{SF}/documents.parquet'").fetchall()[0]
    assert len({r["doc_id"] for r in got}) == len(got) == n and {r["law"] for r in got} == {"bytes"}
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += r["size"]
    assert sum(sums.values()) == total and all(abs(s - total / 8) <= most for s in sums.values())
    assert sorted(map(str, got)) == sorted(map(str, queries.op6_sharding(spark, SF).collect()))


def test_rows_repeated_in_full_are_divided(spark, monkeypatch):
    """A third of the rows are one row: no key range, the unit that a task sorts, holds over twice the mean."""
    ranges = {}
    deal = sharding._deal
    monkeypatch.setattr(sharding, "_deal", lambda bounds: ranges.setdefault("bounds", []).append(bounds) or deal(bounds))
    rows = [(None, "one text of many words", "x")] * 10_000 + [(i, f"text {i} of some words", "x") for i in range(20_000)]
    got = shards(spark, rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in shard) == list(range(len(shard))) for shard in by.values())
    total = sum(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in shard) - total / 8) <= 30 for shard in by.values())
    bounds = ranges["bounds"][-1]
    keys = spark.createDataFrame(rows, "doc_id long, text string, shard string").selectExpr(
        "xxhash64(text) text_hash", f"coalesce(doc_id, {sharding.NULL_ID}) order_id", "xxhash64(monotonically_increasing_id()) salt")
    filled = [r["count"] for r in keys.mapInArrow(deal(bounds), "text_hash long, order_id long, salt long, key_range int").groupBy("key_range").count().collect()]
    assert max(filled) <= 2 * len(rows) / len(filled)
