"""Token counts with a digest cache.

Method: the digest of the normalised content and the digest of the tokenizer's file
are the key of a stored table of counts. Documents are joined to it; only one document of every
digest that the table lacks is encoded, and its count is appended. The counts of all documents are then read
from the table, so a later run over a grown corpus encodes only what is new.

The copies of a text (a third of all rows, perhaps) meet as 32-byte digests that are
combined before the shuffle, which chooses one row of each missing digest; every text then passes one
shuffle to the join that keeps the chosen ones. Normalising must not change
counts: it makes null the empty text and nothing else.

Edge cases: null and empty texts have 0 bytes and the count the tokenizer gives the empty text; repeated rows keep
a row each; an empty table gives an empty result; null ids are kept. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from .common import saved, ship_by_value, small_batches, text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Characters of text that are encoded in one call; bounds the lists of ids in memory.
CALL_CHARS = 200_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _encoder(path: str):
    """list of texts -> list of counts, as the library for the file's kind gives them."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            counts: list[int] = []
            call: list[str] = []
            size = 0
            for text in batch.column("text"):
                call.append(text.as_py())
                size += len(call[-1])
                if size >= CALL_CHARS:
                    counts += encode(call)
                    call, size = [], 0
            counts += encode(call) if call else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of the cache's rows for this tokenizer, one for each digest."""
    if path_exists(spark, cache_path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    else:
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    own = stored.where(F.col("tokenizer") == tokenizer)
    return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have appended the same


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document; counts that ``cache_path`` lacked are appended to it."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    texts = texts.withColumn("digest", content_digest(F.col("text"))).withColumn("row_key", F.xxhash64("doc_id", "text"))
    digests = saved(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", "row_key"),
                    "token-digests")
    one_each = digests.groupBy("digest").agg(F.min("row_key").alias("row_key"))
    misses = one_each.join(read_cache(spark, cache_path, tokenizer), "digest", "left_anti")
    # Of rows repeated in full one is encoded; they lie together after the join.
    found = texts.select("digest", "row_key", "text").join(misses, ["digest", "row_key"]).dropDuplicates(["digest", "row_key"])
    counts = found.select("digest", "text").mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens long")
    counts.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return digests.join(read_cache(spark, cache_path, tokenizer), "digest").select("doc_id", "n_bytes", "n_tokens")


ship_by_value(__name__)
