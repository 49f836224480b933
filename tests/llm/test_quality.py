import random

import duckdb
import numpy as np
from freightcube.llm import quality, queries
from freightcube.llm.common import Sums

SF = "/root/testdata/sf0.1"


def test_estimate_recovers_labellers():
    rnd = np.random.default_rng(4)
    good = rnd.random(20_000) < 0.8
    bad_rate, good_rate = [0.95, 0.7, 0.6, 0.9], [0.02, 0.05, 0.1, 0.3]  # chance of a bad vote by class
    votes = np.stack([np.where(rnd.random(len(good)) < np.where(good, g, b), quality.BAD, quality.GOOD)
                      for b, g in zip(bad_rate, good_rate)], axis=1).astype(np.int8)
    votes[rnd.random(votes.shape) < 0.2] = quality.NONE
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, chances = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02
    for i, (b, g) in enumerate(zip(bad_rate, good_rate)):
        assert abs(chances[i, 0, 0] / (1 - chances[i, 0, 2]) - b) < 0.05 and abs(chances[i, 1, 0] / (1 - chances[i, 1, 2]) - g) < 0.05
    assert ((posterior[inverse.ravel()] > 0.5) == good).mean() > 0.95


def test_measures_do_not_depend_on_blocks(monkeypatch):
    text = np.frombuffer(("The cat sat. THE!! dog%% | ran, go go now. " * 40).encode(), np.uint8)
    whole = dict(zip(quality.MEASURES, quality.measures(text, Sums())))
    assert whole["words"] == 40 * 10 and whole["bare_signs"] == 40 and whole["shouts"] == 40 and whole["repeated_words"] == 40
    assert whole["distinct_pairs"] == 10 and whole["ended_words"] == 40 * 3
    features = quality.features(text, quality.measures(text, Sums()), Sums())
    monkeypatch.setattr(quality, "BLOCK", 64)
    in_blocks = dict(zip(quality.MEASURES, quality.measures(text, Sums())))
    assert all(in_blocks[k] == whole[k] for k in ("bytes", "lower", "upper", "digits", "signs"))
    assert np.allclose(quality.features(text, [whole[k] for k in quality.MEASURES], Sums()), features)


def test_every_measure_is_of_the_whole_text(monkeypatch):
    rnd = random.Random(5)
    passage = "".join(rnd.choice(["ab", "The", "x9", "%%", "go!", "end.", "W" * 90, "é"]) + rnd.choice([" ", "  ", "\n"]) for _ in range(60))
    texts = [passage * 5, passage.strip(), "w" * 500, " " * 300, "", "a", " a", "a b " * 200, passage + "tail"]
    texts = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [quality.measures(t, Sums()).tolist() for t in texts]
    for block in (1, 2, 7, 64, 100, 500):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert [quality.measures(t, Sums()).tolist() for t in texts] == whole


def test_training_draw_is_bounded_by_keys(spark):
    """Rows repeated in full are one drawn key that stands for its share of the sample."""
    rows = [(7, "1-0")] * 3000 + [(k, "11-") for k in range(100, 6100)] + [(9, "---")] * 1000
    drawn = quality.drawn_keys(spark.createDataFrame(rows, "row_key long, pattern string"), 100 / len(rows)).collect()
    assert [(r["pattern"], r["rows"]) for r in drawn if r["row_key"] == 7] == [("1-0", 30.0)]
    assert 30 < len(drawn) < 100 and all(r["rows"] == 1 and r["pattern"] == "11-" for r in drawn if r["row_key"] != 7)


def test_training_sample_holds_each_text_once(spark, monkeypatch):
    rnd, sizes = random.Random(2), []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **how: (sizes.append((len(x), float(how["rows"].sum()))), fit(x, y, **how))[1])
    rows = [(i, " ".join(rnd.choices(["kalo", "mine", "of", "rust", "the", "and"], k=40)) + ".") for i in range(200)] + [(None, "the cat sat. " * 9)] * 100
    quality.classify_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), train_rows=300).collect()
    assert sizes == [(201, 300.0)]


def test_held_out_accuracy(spark):
    """The labels of the table are not used to fit anything."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["keep"] for r in quality.classify_quality(docs).select("row.doc_id", "keep").collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good, bad = ([got[i] for i, q in labels.items() if q == x] for x in (1, 0))
    assert len(got) == docs.count() and np.mean(good) > 0.999 and np.mean(bad) < 0.03


def test_edge_cases(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices(["ka", "lo", "mi", "ne", "ru", "st"], k=rnd.randint(1, 4))) for _ in range(600)] + ["the", "of", "and"] * 60
    clean = lambda: "".join(" ".join(rnd.choices(words, k=9)).capitalize() + ". " for _ in range(12))
    rows = [(i, clean(), "x", 1) for i in range(60)] + [(100 + i, " ".join(w + "%%%" for w in rnd.choices(words, k=80)), "x", 1) for i in range(12)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, "é", "x", 1), (None, clean(), "x", 1), (5, rows[5][1], "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string, keep int")
    out = quality.classify_quality(frame)
    got = [(r["row"]["doc_id"], r["keep"], r["score"]) for r in out.collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert all(keep == (i is None or not 100 <= i < 200) for i, keep, _ in got)
    assert len({s for i, _, s in got if i == 5}) == 1
    assert {(r["row"]["score"], r["row"]["keep"]) for r in out.collect()} == {("x", 1)}
    assert quality.classify_quality(frame.limit(0)).count() == 0
    only_empty = quality.classify_quality(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert [r["keep"] for r in only_empty.collect()] == [True, True]


def test_quality_query(spark):
    got = queries.op2_quality(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "score", "keep"] and got.count() == 1000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.op2_quality(spark, "/root/testdata/sf0.01").collect()))
