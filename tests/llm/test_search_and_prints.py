import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from freightcube.llm import fingerprints, queries, simhash
from freightcube.llm.graph import connected_components
from freightcube.llm.topk_search import top_k
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def vectors(seed=3, n=400, dims=6):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(dims)], "x") for i in range(n)]
    hot = [0.5] * dims
    rows += [(1000 + i, hot, "x") for i in range(200)]  # one vector many times: ties
    rows += [(2000, None, "x"), (2001, [1.0, None, 2.0], "x"), (2002, [NAN] * dims, "x"), (2003, [INF] * dims, "x"), (None, hot, "x"),
             (2100, [], "x"), (2200, [1.0, 2.0], "x"), (7, hot, "x"), (7, hot, "x"), (300, [1e9, -1e9, 0.0, 0.0, 0.0, 0.0], "x")]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_rows": 16, "block_rows": 3, "leaf_rows": 2}])
def test_top_k(spark, how):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    by_query = {}
    for i, v in whole:
        if i % 50 == 0:
            by_query[i] = min(by_query.get(i, v), v)
    want = []
    for q, v in by_query.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:10], 1)]
    assert sorted(map(tuple, top_k(frame, F.col("vec_id") % 50 == 0, **how).collect())) == sorted(want)


@pytest.mark.parametrize("size", [2e4, 3e5])
def test_top_k_of_large_components(spark, size):
    """Products beyond 32 bits, and beyond what float64 holds, on both sides and with ties one apart."""
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    rows += [(300 + i, [rnd.choice((-1, 1)) * size * rnd.random()] * 3 + [i / 1024] + [rnd.gauss(0, 1) for _ in range(60)]) for i in range(40)]
    rows += [(1000, [size] * 4 + [0.2] * 60), (2000, [-size] + [size] * 63), (3000, [0.2] * 64)]
    rows += [(4000 + i, [size] * 63 + [size + i / 1024]) for i in range(30)]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:10], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for how in ({}, {"shard_rows": 16, "block_rows": 3, "leaf_rows": 2}):
        assert sorted(map(tuple, top_k(frame, F.col("vec_id") % 100 == 0, **how).collect())) == sorted(want)


def test_top_k_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    every = F.col("vec_id") % 100 == 0
    assert top_k(spark.createDataFrame([], schema), every).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0])], schema), every).collect() == []
    assert top_k(spark.createDataFrame([(1, [1.0])], schema), every).collect() == []
    assert list(map(tuple, top_k(spark.createDataFrame([(0, [1.0]), (5, [2.0])], schema), every).collect())) == [(0, 1, 5, 2 << 20)]


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in words).split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, most):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


@pytest.mark.parametrize("cell", [48, 1])
def test_components_of_chains_and_clusters(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "SMALL_CELL", cell)
    rnd = random.Random(6)
    prints = [rnd.getrandbits(64) for _ in range(120)] + [0, (1 << 64) - 1]
    for base in prints[:10]:  # chains of steps of up to five bits, and clusters around a point
        at = base
        for _ in range(15):
            for _ in range(rnd.randint(1, 5)):
                at ^= 1 << rnd.randrange(64)
            prints.append(at)
        prints += [base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(30)]
    ids = rnd.sample(range(10_000), len(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, print long")
    got = {r["print"]: r["component_id"] for r in simhash.fingerprint_components(frame, 4).collect()}
    want = brute_components(ids, prints, 4)
    assert all(got[p] == want[i] for i, p in zip(ids, signed)) and len(got) == len(set(prints))


def test_popcount_bound():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    embedded = lambda x: np.array([[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x])
    manhattan = np.abs(embedded(a) - embedded(b)).sum(axis=1)
    assert (np.bitwise_count(simhash.popcounts(a) ^ simhash.popcounts(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_simhash_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "PART", 20)  # long texts come in parts
    rnd = random.Random(2)
    long = " ".join(rnd.choices(["Alpha", "beta", "GAMMA", "é\x0bx", "d\x1ce", "f g"], k=90))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "One", "x"), (5, "one two three", "x"), (6, "One two Three four", "x"), (7, long, "x"),
            (8, long + " tail", "x"), (9, "ÀÉ a b c d", "x"), (7, long, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = {r["doc_id"]: (r["print"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(frame).collect()}
    prints = {i: brute_print(t) for i, t, _ in rows}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute_components(list(prints), list(prints.values()), 4)
    kept = simhash.one_of_each(spark.createDataFrame([*rows, (None, long, "x"), (None, "alone here", "x"), (None, "alone here", "x")], frame.schema))
    components = set(c for _, c in got.values())
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([*components, -1]) and kept.columns == frame.columns
    assert simhash.simhash_components(spark.createDataFrame([], frame.schema)).count() == 0


def test_large_cells_are_dealt_to_blocks(spark, monkeypatch):
    """A family of near fingerprints, a third of all: the components of all pairs, and no task with more than two blocks of a cell."""
    rnd = random.Random(13)
    base = rnd.getrandbits(64)
    family = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 9]))) for _ in range(300)}
    prints = sorted(family | {rnd.getrandbits(64) for _ in range(300)})
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, print long")
    held = spark.sparkContext.accumulator(0)
    groups = simhash.whole_groups

    def watched(batches, key):
        for table in groups(batches, key):
            cells = table.column(key).to_numpy()
            held.add(int(np.unique(cells, return_counts=True)[1].max() > 64))
            yield table

    want = brute_components(range(len(prints)), prints, 4)
    for block in (4096, 16):
        monkeypatch.setattr(simhash, "BLOCK_PRINTS", block)
        monkeypatch.setattr(simhash, "whole_groups", watched)
        before = held.value
        got = {r["print"] % (1 << 64): r["component_id"] for r in simhash.fingerprint_components(frame, 4).collect()}
        assert got == {p: want[i] for i, p in enumerate(prints)}
        assert (held.value > before) == (block == 4096)  # two blocks of 16 are some 32 fingerprints


def test_one_of_each_does_not_depend_on_row_order(spark):
    """Rows equal in id and text, and near copies without id, differ in other columns."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i % 3 or None, words if i % 2 else "other " + words[:40], lang, source) for i in range(6) for lang in ("en", "de", None) for source in ("a", None)]
    schema = "doc_id long, text string, lang string, source string"
    kept = {tuple(sorted(map(repr, simhash.one_of_each(spark.createDataFrame(order, schema)).collect())))
            for order in (rows, rows[::-1], rows[5:] + rows[:5])}
    assert len(kept) == 1


def test_simhash_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    prints = [brute_print(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for (i, _), p in zip(rows, prints)}


def test_connected_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rnd = random.Random(7)
    draw = lambda: np.array([rnd.randrange(3) for _ in range(rnd.choice([0, 1, 5, 20, 63, 64]))], np.int16)
    pairs = [(draw(), draw()) for _ in range(300)]
    assert fingerprints.edit_distances(pairs).tolist() == [levenshtein(a, b) for a, b in pairs]


def brute_fingerprint(data):
    """Byte by byte."""
    mask = (1 << 32) - 1
    ends = {}
    for bits in range(2, 40):
        ends[bits] = []
        for i in range(len(data)):
            h = sum((data[i - back] + 1) * pow(0x01000193, back + 1, 1 << 32) for back in range(min(7, i + 1))) & mask
            h ^= h >> 15
            h = h * 0x2C1B3C6D & mask
            h ^= h >> 13
            if h % (1 << min(bits, 32)) == 0 and i + 1 < len(data):
                ends[bits].append(i + 1)
        if bits > 2 and len(ends[bits - 1]) + 1 <= 64:
            break
    chosen = min(b for b in ends if len(ends[b]) + 1 <= 64)
    return chosen, [len(ends[chosen]) + 1, len(ends[chosen + 1]) + 1]


def test_fingerprint_boundaries():
    rnd = random.Random(3)
    for n in (1, 3, 7, 100, 700, 1500):
        data = bytes(rnd.choices(b"abcdefgh ", k=n))
        bits, first, second = fingerprints.Hasher().fingerprint(data)
        assert (bits, [len(first), len(second)]) == brute_fingerprint(data)
    shown = fingerprints.show((bits, first, second))
    back = fingerprints.parse(shown)
    assert back[0] == bits and (back[1] == first).all() and (back[2] == second).all()


def test_fingerprint_in_parts(monkeypatch):
    rnd = random.Random(8)
    texts = [bytes(rnd.choices(b"abcdefgh ", k=n)) for n in (1, 31, 32, 33, 64, 500, 5000, 40_000)] + [b"a" * 3000, b"ab" * 2000]
    whole = [fingerprints.Hasher().fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprints, "PART", 32)
    parts = [fingerprints.Hasher().fingerprint(t) for t in texts]
    assert [fingerprints.show(p) for p in parts] == [fingerprints.show(p) for p in whole]


def test_fingerprint_likeness():
    rnd = random.Random(5)
    hasher = fingerprints.Hasher()
    text = "".join(rnd.choices("abcdefghij ", k=6000))
    near = text[:3000] + "inserted words" + text[3020:]
    other = "".join(rnd.choices("abcdefghij ", k=6000))
    prints = [hasher.fingerprint(x.encode()) for x in (text, text, near, other, "", "")]
    same, close, far, empty, none = fingerprints.likeness([(prints[0], prints[i]) for i in (1, 2, 3)] + [(prints[4], prints[5]), (prints[0], prints[4])])
    assert same == 1 and close > 0.85 and far < 0.15 and empty == 1 and none == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_fingerprint_table(spark, parts):
    rnd = random.Random(parts)
    rows = [(i, "".join(rnd.choices("abcdé fg\n", k=rnd.choice([0, 1, 2, 50, 900]))), "x") for i in rnd.sample(range(1000), 60)]
    rows += [(2000, None, "x"), (2001, "same", "x"), (2002, "same", "x")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    hasher, ordered = fingerprints.Hasher(), sorted(rows, reverse=True)
    for (i, text, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        prints = [hasher.fingerprint(x.encode()) for x in (text, edited, following)]
        near = fingerprints.likeness([(prints[0], prints[1]), (prints[0], prints[2])])
        assert tuple(got[i]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.show(prints[0]), fingerprints.show(prints[1]), *near)
    assert len(got) == len(rows)


def test_fingerprint_degenerate(spark):
    schema = "doc_id long, text string"
    run = lambda rows: fingerprints.fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    assert run([]) == []
    assert [(r["near_edited"], r["near_next"]) for r in run([(1, "ab" * 600)])] and run([(1, "ab" * 600)])[0]["near_next"] == 1
    assert sorted(r["doc_id"] or -1 for r in run([(None, "a"), (None, "a"), (3, "b"), (3, "b")])) == [-1, -1, 3, 3]
