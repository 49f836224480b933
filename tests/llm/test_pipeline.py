"""Every stage of the pipeline against brute force over that stage's own input."""

import base64
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from freightcube.llm.common import saved
from freightcube.llm.quality import classify_quality
from test_mixing_sharding import fill
from test_search_and_prints import brute_components, brute_print

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(5000, None, "en", None, 0), (5001, "", "en", "src1", 0), (5002, "", "en", None, 0), (5003, "One of the few. And more of them.", "en", None, 33)]
    docs = docs.union(spark.createDataFrame([*extra, extra[3], *map(tuple, docs.limit(2).collect())], docs.schema))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS and docs.dtypes == before.dtypes
        out[name] = (before.collect(), docs.collect(), before)
    return out


def test_names(stages):
    assert [n.split()[0] for n in stages] == ["quality", "SimHash", "suffix-array", "mixing", "byte-level"]


def test_quality_stage(stages):
    before, after, frame = stages["quality classifier"]
    judged = classify_quality(frame).collect()
    assert Counter(map(tuple, after)) == Counter(tuple(r["row"]) for r in judged if r["keep"])
    assert 0.5 * len(before) < len(after) < len(before)


def test_near_duplicate_stage(stages):
    before, after, _ = stages["SimHash near-dedup"]
    rows = sorted(set(map(tuple, before)), key=lambda r: r[0])
    component = brute_components([r[0] for r in rows], [brute_print(r[1]) for r in rows], 4)
    assert Counter(map(tuple, after)) == Counter(r for r in rows if component[r[0]] == r[0])


def test_repeats_stage(stages):
    before, after, _ = stages["suffix-array dedup"]
    data = {r["doc_id"]: (r["text"] or "").encode() for r in before}
    seen = Counter(hash(d[i:i + 200]) for d in data.values() for i in range(len(d) - 199))
    got = {r["doc_id"]: r for r in after}
    assert len(got) == len(after) == len(before)
    changed = 0
    for r in before:
        d, gone = data[r["doc_id"]], np.zeros(len(data[r["doc_id"]]), bool)
        for i in range(len(d) - 199):
            if seen[hash(d[i:i + 200])] > 1:
                gone[i:i + 200] = True
        text, at = "", 0
        for c in r["text"] or "":
            size = len(c.encode())
            text += "" if gone[at:at + size].all() else c
            at += size
        new = got[r["doc_id"]]
        assert new["text"] == (None if r["text"] is None else text) and new["lang"] == r["lang"] and new["source"] == r["source"]
        assert new["n_chars"] == (len(text) if gone.any() else r["n_chars"])
        changed += bool(gone.any())
    assert changed > 5


def test_mixing_stage(stages):
    before, after, _ = stages["mixing sources to target weights"]
    words = lambda t: (t or "").split(" ") if False else [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    sources = defaultdict(int)
    for r in before:
        sources[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [s for s in sources if s is None]
    targets = dict(zip(names, fill([sources[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3)))
    taken = defaultdict(int)
    by_id = {r["doc_id"]: r for r in before}
    cut = defaultdict(int)
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
        whole = by_id[r["doc_id"]]
        assert words(r["text"]) == words(whole["text"])[:len(words(r["text"]))]
        cut[r["source"]] += len(words(r["text"])) < len(words(whole["text"]))
    assert all(abs(taken[s] - targets[s]) < 1 and cut[s] <= 1 for s in names)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3


def test_mixing_keeps_rows_apart_that_differ_elsewhere(spark):
    rows = [(1, "a b", "en", "s", 3, ["p", None]), (1, "a b", "de", "s", 3, ["p", None]), (1, "a b", "de", "s", 4, ["p", None]),
            (1, "a b", None, "s", 4, [None, "p"]), (1, "a b", None, "s", 4, ["p", None]), (2, "a b", "en", "s", None, None), (2, "a b", "en", "s", None, None),
            (3, " ", "en", "s", 1, None), (4, None, "en", "s", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `an extra` array<string>")
    got = corpus_pipeline.mixture(spark, docs, SF).collect()
    assert Counter(map(str, map(tuple, got))) == Counter(map(str, rows[:7]))  # one source, so each row is taken once


def test_tokens_stage(stages):
    before, after, _ = stages["byte-level BPE encoding and decoding"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], r["text"] or "", np.array(model.encode_ordinary(r["text"] or ""), "<u4").tobytes()) for r in before)
    assert Counter((r["doc_id"], r["text"], bytes(r["ids"])) for r in after) == want
    assert all(4 * r["n_tokens"] == len(r["ids"]) for r in after)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_tokens", "ids", "text"] and 50 < rows.count() < 600


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


def test_a_run_leaves_only_its_result(spark):
    import os

    from freightcube.session import scratch_path
    folder = scratch_path(spark, "llm").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-byte-level-BPE") and docs.count() > 100
