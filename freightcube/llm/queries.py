"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_documents, encode_documents
from .chat import format_conversations, read_back
from .common import read_table, scratch
from .fingerprints import fingerprint_documents
from .html_text import extract_pages
from .merkle import fold, leaf_digest, merkle_manifest, proof_digest
from .mixing import mix_sources
from .quality import classify_quality
from .sharding import shard_by_bytes
from .simhash import print_hex, simhash_components
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .topk_search import top_k
from .whitening import whiten

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: The first id that the ranks of BYTE_BPE leave free.
FREE_ID = 50256
TOKEN_LIMIT = 4096


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", "score", "keep")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=200)
    return cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", print_hex().alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return decode_documents(encoded, BYTE_BPE).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of this query is new, so every distinct text is encoded."""
    counted = count_tokens(read_table(spark, sf_dir, "documents"), PIECE_BPE, scratch(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    formatted = format_conversations(turns.unionByName(planted), BYTE_BPE, public_tokenizers.PATTERN, FREE_ID)
    return read_back(formatted, BYTE_BPE, FREE_ID)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """One row per vector and component; deviations beyond 64 bits are null."""
    rows, model = whiten(vectors, components=32, scale=64, shift=1_000_000)
    explained = F.array(*[F.lit(x) for x in (model.explained if model else [])]).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                       F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"),
                       F.lit(model.identity_error if model else 0.0).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(read_table(spark, sf_dir, "embeddings"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def merkle_rows(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and the root that each row leads to after some texts lost their line ends."""
    broken = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(broken, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    tampered = leaf_digest([text if c == "text" else F.col(c) for c in LEAF_FIELDS])
    proved = merkle_manifest(docs, LEAF_FIELDS, extra={"tampered": F.unhex(tampered)})
    folded = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                           fold(F.lower(F.hex("tampered")), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(read_table(spark, sf_dir, "documents").select(*LEAF_FIELDS))


_OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS crcs
  FROM range(256) t(i)),
texts AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS digits FROM documents),
checked AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(range(1, 1 + length(digits)),
             lambda c, k: xor(c >> 8, crcs[1 + (xor(c, ord(digits[k])) & 255)]), 4294967295), 4294967295) AS crc
  FROM texts, crc_table),
fields AS (
  SELECT doc_id, source,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(text, '') AS text, text IS NULL AS no_text, coalesce(crc % 2 = 0, false) AS broken
  FROM checked),
leaves AS (
  SELECT doc_id, source, sha256(head || CASE WHEN no_text THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN broken AND NOT no_text THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''))
              ELSE sha256(head || CASE WHEN no_text THEN '-' ELSE strlen(text) || ':' || text END) END AS tampered
  FROM fields),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM leaves),
nodes AS (
  SELECT source, 0 AS level, nth, leaf AS digest, count(*) OVER (PARTITION BY source) AS width FROM ranked
  UNION ALL
  SELECT source, level + 1, nth // 3, sha256(string_agg(digest, '' ORDER BY nth)), CAST(ceil(any_value(width) / 3.0) AS BIGINT)
  FROM nodes WHERE width > 1 GROUP BY source, level, nth // 3),
tops AS (SELECT source, digest AS subroot, level AS height FROM nodes WHERE width = 1),
upper_nodes AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS nth, subroot AS digest, count(*) OVER () AS width FROM tops
  UNION ALL
  SELECT level + 1, nth // 3, sha256(string_agg(digest, '' ORDER BY nth)), CAST(ceil(any_value(width) / 3.0) AS BIGINT)
  FROM upper_nodes WHERE width > 1 GROUP BY level, nth // 3),
roots AS (SELECT digest AS root FROM upper_nodes WHERE width = 1),
paths AS (
  SELECT source, nth AS leaf_nth, level, nth, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS proof FROM nodes WHERE level = 0
  UNION ALL
  SELECT p.source, p.leaf_nth, p.level + 1, p.nth // 3,
         list_append(any_value(p.proof), {'l': coalesce(string_agg(s.digest, '' ORDER BY s.nth) FILTER (s.nth < p.nth), ''),
                                          'r': coalesce(string_agg(s.digest, '' ORDER BY s.nth) FILTER (s.nth > p.nth), '')})
  FROM paths p JOIN nodes s ON p.source IS NOT DISTINCT FROM s.source AND p.level = s.level AND p.nth // 3 = s.nth // 3
  WHERE s.width > 1 GROUP BY p.source, p.leaf_nth, p.level, p.nth),
upper_ranks AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS nth FROM tops),
upper_paths AS (
  SELECT source, 0 AS level, nth, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS proof FROM upper_ranks
  UNION ALL
  SELECT p.source, p.level + 1, p.nth // 3,
         list_append(any_value(p.proof), {'l': coalesce(string_agg(s.digest, '' ORDER BY s.nth) FILTER (s.nth < p.nth), ''),
                                          'r': coalesce(string_agg(s.digest, '' ORDER BY s.nth) FILTER (s.nth > p.nth), '')})
  FROM upper_paths p JOIN upper_nodes s ON p.level = s.level AND p.nth // 3 = s.nth // 3
  WHERE s.width > 1 GROUP BY p.source, p.level, p.nth),
proofs AS (
  SELECT r.doc_id, r.leaf, r.tampered, t.subroot, list_concat(p.proof, u.proof) AS proof
  FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source
  JOIN paths p ON r.source IS NOT DISTINCT FROM p.source AND r.nth = p.leaf_nth AND p.level = t.height
  JOIN upper_paths u ON r.source IS NOT DISTINCT FROM u.source AND u.level = (SELECT max(level) FROM upper_nodes))
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(proof, lambda x: x.l || x.r)), 'string_agg', '')) AS proof_sha256,
       list_reduce(list_transform(proof, lambda x: x.l || '|' || x.r), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2)), tampered) AS folded_root,
       folded_root = root AS verified
FROM proofs, roots
"""

_OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS nth
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (nth - 1) % 3 AS weight, 3 * source_size AS stop, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, row_number() OVER w AS rnk,
         CAST(total - coalesce(sum(stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY stop / weight, nth)),
opened AS (SELECT min(rnk) AS first_open FROM levels WHERE stop >= level * weight),
targets AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR rnk < first_open THEN CAST(stop AS DOUBLE)
              ELSE (SELECT level FROM levels, opened WHERE rnk = first_open) * weight END AS target
  FROM levels, opened),
lined AS (
  SELECT doc_id, size, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized),
cuts AS (
  SELECT doc_id, size, source_size, target, ahead, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM lined l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM cuts
"""

_OP1_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM scored)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rnk <= 10
"""

_OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
measured AS (
  SELECT *, 16 + length(role) + length(text)
         + len(regexp_extract_all(role, '[<\[]\\*/?(s>|INST\])')) + len(regexp_extract_all(text, '[<\[]\\*/?(s>|INST\])')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + 4 AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_chat_format": op9_chat_format,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_html_text": op12_html_text,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op1_topk_search": _OP1_SQL, "op9_chat_format": _OP9_SQL, "op10_mixing": _OP10_SQL,
                              "op13_merkle": _OP13_SQL}
