import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from freightcube.llm import merkle, queries
from freightcube.llm.common import saved
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return sha("".join(field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(digests):
    """Root of a tree and, for each leaf, (left, right) level by level."""
    at, proofs, level = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(level) > 1:
        for i, proof in enumerate(proofs):
            run = at[i] // 3 * 3
            proof.append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + 3])))
            at[i] //= 3
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in by[s]]) for s in names]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, proofs), upper in zip(names, trees, above):
        for r, proof in zip(by[s], proofs):
            proof = proof + upper
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                changed["text"] = r["text"].replace("\n", "")
            digest = leaf(changed)
            for left, right in proof:
                digest = sha(left + digest + right)
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(a + b for a, b in proof)), digest, digest == root))
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, queries.merkle_rows(df).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 1}, {"a": 4, "b": 27, "": 28, None: 2}, {"hot": 900, "é": 82, "z": 81, "Z": 10, "x": 9}])
def test_equals_brute_force(spark, sizes):
    draw = random.Random(7)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((draw.choice([None, i, 5 * i, 7]), draw.choice([None, "", "a\nb", f"text {i}\n", "é\r\n"]), draw.choice([None, "en", ""]), source,
                         draw.choice([None, 0, i])))
    rows += rows[:3]  # rows repeated in full
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(df) == brute([r.asDict() for r in df.collect()])


def test_empty_and_one_long(spark):
    assert told(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(0, "line\n" * 400_000, "en", None, None)], SCHEMA)
    assert told(df) == brute([r.asDict() for r in df.collect()])


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, f"t{i}\n", "en", "ab"[i % 2], i) for i in range(40)], SCHEMA)
    names = ["name", "unnamed", "id", "digest", "more", "lo", "hi", "load", "part", "row", "level0", "steps", "above", "root", "leaf", "proof", "a b"]
    assert told(df.select("*", *[F.lit("x").alias(c) for c in names])) == told(df)


def test_proofs_of_the_operator(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "ab"[i % 2], i) for i in range(57)], SCHEMA)
    rows = merkle.merkle_manifest(df, extra={"chars": F.length("text")}).withColumn("top", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["top"] == r["root"] for r in rows) and {r["chars"] for r in rows} == {2, 3}
    for s in "ab":
        assert sorted(r["rank"] for r in rows if r["source"] == s) == list(range(sum(r["source"] == s for r in rows)))
    # Other fields, other roots.
    assert merkle.merkle_manifest(df, fields=["text"]).first()["root"] != rows[0]["root"]


def test_a_hot_source_is_spread(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(merkle, "saved", lambda df, name: tables.setdefault((name, len(tables)), saved(df, name)))
    rows = [(None if i % 3 else i, "same", "en", "hot" if i % 10 else f"s{i}", 4) for i in range(8000)]
    merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    ranks = next(t for (name, _), t in tables.items() if name == "merkle-ranks")
    assert ranks.groupBy("part").count().agg(F.max("count")).first()[0] < 3 * 8000 / 8
    assert all(t.select(F.max(F.size("level0"))).first()[0] <= 27 for (name, _), t in tables.items() if name == "merkle-buckets")
