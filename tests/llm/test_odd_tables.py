"""Tables with columns of clashing and odd names, nulls in any column, repeated rows and a long text."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from freightcube.llm import bpe, fingerprints, mixing, quality, sharding, simhash, suffix_dedup, token_counts
from freightcube.llm.common import scratch
from freightcube.llm.queries import BYTE_BPE, PIECE_BPE
from pyspark.sql import functions as F

CLASHING = ["row", "own_id", "text_key", "row_key", "key", "digest", "print", "root", "spans", "kept", "position", "digit", "context", "part",
            "place", "score", "keep", "pattern", "shard", "slot", "size", "taken", "target", "ids", "decoded", "n_tokens", "name", "words",
            "a b", "x:y", "d.o.t"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    null = (None,) * 5
    odd = [null, null, (7000, None, None, None, None), (7001, "", "en", "src0", 0), (7002, "Words of one. " * 30_000, "en", "src1", 420_000),
           (7003, "a", None, None, None), (7003, "a", None, None, None), (7003, "another text, same id", "en", None, 21), (-5, "é" * 999, "en", "src1", 999)]
    return table.union(spark.createDataFrame(odd, table.schema)).cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING])


OPERATORS = {
    "quality": lambda d, s: quality.classify_quality(d).select("row.doc_id", "row.text", "score", "keep"),
    "fingerprints": lambda d, s: fingerprints.fingerprint_documents(d),
    "repeats": lambda d, s: suffix_dedup.remove_repeats(d).select("row.doc_id", "n_bytes", "n_removed", "spans", "kept"),
    "simhash": lambda d, s: simhash.simhash_components(d),
    "one of each": lambda d, s: simhash.one_of_each(d).select("doc_id", "text"),
    "shards": lambda d, s: sharding.shard_by_bytes(d),
    "bpe": lambda d, s: bpe.decode_documents(bpe.encode_documents(d, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE),
    "tokens": lambda d, s: token_counts.count_tokens(d, PIECE_BPE, scratch(s, "cache")),
    "mix": lambda d, s: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, docs, wide, name):
    plain, extra = (Counter(map(repr, OPERATORS[name](d, spark).collect())) for d in (docs, wide))
    assert plain == extra
    if name != "one of each":
        assert sum(plain.values()) == docs.count()


def test_stages(spark, docs, wide):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, extra = stage(spark, docs, ""), stage(spark, wide, "")
        assert plain.columns == docs.columns and extra.columns == wide.columns
        rows = extra.collect()
        assert Counter(map(repr, plain.collect())) == Counter(repr(r) for r in extra.select(*docs.columns).collect())
        assert all(r[c] == f"{c}!" for r in rows for c in CLASHING)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() == docs.count()
