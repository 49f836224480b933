"""A training-data pipeline over ``documents``.

Every stage takes the documents that the one before it kept, written as Parquet in the shared folder and read again, and
returns documents with the columns of the table; the last returns encoded documents. Null, empty and repeated rows
are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightcube.llm.bpe import decode_documents, encode_documents
from freightcube.llm.common import quoted, read_table, row_of, saved
from freightcube.llm.mixing import mix_sources
from freightcube.llm.quality import classify_quality
from freightcube.llm.queries import BYTE_BPE
from freightcube.llm.simhash import one_of_each
from freightcube.llm.suffix_dedup import remove_repeats
from freightcube.session import remove_path, scratch_scope

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return classify_quality(docs).where("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return one_of_each(docs, shingle=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the code points that lie in repeated strings of 200 bytes; n_chars follows."""
    cut = remove_repeats(docs, threshold=200, whole_characters=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[changed.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of a document as the mix takes whole, and where it takes a part, the first words of another.

    Documents without words (null, empty or white space) have nothing that the mix could take, and leave it.
    """
    keys = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("own_id"), F.col("doc_id").isNull().alias("unnamed")]
    # A hash of the whole row; hashes pass over nulls, which are therefore told apart by flags.
    nested = {c for c, t in docs.dtypes if t.startswith(("array", "map", "struct"))}
    values = [F.to_json(F.struct(quoted(c))) if c in nested else F.col(quoted(c)) for c in docs.columns]
    text_key = F.xxhash64(*values, *[F.col(quoted(c)).isNull() for c in docs.columns]).alias("text_key")
    docs_keyed = docs.select(row_of(docs), *keys, text_key)
    names = ["own_id", "unnamed", "text_key"]
    # Rows repeated in full take words together, so that each key has one row on either side of the join.
    mixed = mix_sources(docs, weights=(1, 2, 3), max_epochs=3, extra={"text_key": text_key})
    taken = mixed.select(*keys, "text_key", "size", "taken").groupBy(*names).agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    parts = docs_keyed.dropDuplicates(names).join(taken.where("taken > 0"), names)
    parts = parts.withColumn("words", F.explode(F.expr("sequence(1, cast((taken + size - 1) div size as int))")))
    words = F.least("size", F.col("taken") - (F.col("words") - 1) * F.col("size"))  # of this copy
    head = F.array_join(F.slice(F.split(F.regexp_replace("row.text", f"^{WHITE_SPACE}", ""), WHITE_SPACE), 1, words.cast("int")), " ")
    text = F.when(words < F.col("size"), head).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(words < F.col("size"), F.length(head).cast("long")).otherwise(F.col("row.n_chars"))}
    return parts.select(*[changed.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text that the ids decode to."""
    encoded = encode_documents(docs, BYTE_BPE, public_tokenizers.PATTERN)
    return decode_documents(encoded, BYTE_BPE).select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier, the fingerprints' hash and the tokenizer have no SQL form; tests/llm compares stages 2 to 5 with brute force, and the
#: classifier with held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage made on its way goes when its result is written, and that goes when the next one's is."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as made:
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            result = made.pop()  # written last
        if before:
            remove_path(spark, before)
        before = result
    return docs
