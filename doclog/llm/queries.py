"""The queries over whole tables that __spark_entry__ registers, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from . import hnsw, manifest, packing, pieces, ppm, quality, runs, sharding, simhash, suffixes, topk, toxicity, warc
from .common import table, text_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return packing.pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, 20)


ORACLES["op2_exact_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.t, c.t) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


ORACLES["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages WHERE page_id IS NOT NULL
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op9_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (SELECT a AS n, a AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n), d AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.n = e.vec_id LEFT JOIN d ON d.n = e.vec_id
"""


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text_bytes()).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(docs, 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Columns of a leaf, in order.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in DOCUMENT)))
    log, top = manifest.manifest(docs.withColumn("claimed", changed), "source", "doc_id", DOCUMENT)
    return manifest.verified(log, top).withColumnRenamed("order_key", "doc_id")


ORACLES["op12_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(4294967295::UBIGINT, list_reduce(
           list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
           lambda s, b: list_reduce(list_concat([xor(s, b)], list_transform(range(8), lambda z: z::UBIGINT)), lambda t, z: xor(t >> 1, 3988292384::UBIGINT * (t & 1))))) AS crc
  FROM documents
), p AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d
), leaf AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS claimed FROM p
), numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS rid FROM leaf),
node AS (
  SELECT g, 0 AS level, i, leaf AS h FROM numbered
  UNION ALL
  SELECT g, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM node) WHERE n > 1 GROUP BY g, level, i // 16
), sub AS (SELECT g, arg_max(h, level) AS subroot FROM node GROUP BY g), subs AS (SELECT *, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM sub),
tops AS (
  SELECT 0 AS level, i, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, i // 16
), root AS (SELECT arg_max(h, level) AS root FROM tops),
sides AS (
  SELECT r.rid, k.level AS step, k.i < (r.i // CAST(pow(16, k.level) AS BIGINT)) AS before, k.i, k.h FROM numbered r JOIN node k ON k.g = r.g
   AND k.i // 16 = r.i // CAST(pow(16, k.level + 1) AS BIGINT) AND k.i <> r.i // CAST(pow(16, k.level) AS BIGINT)
  UNION ALL
  SELECT r.rid, 100 + k.level, k.i < (s.i // CAST(pow(16, k.level) AS BIGINT)), k.i, k.h FROM numbered r JOIN subs s ON s.g = r.g JOIN tops k
    ON k.i // 16 = s.i // CAST(pow(16, k.level + 1) AS BIGINT) AND k.i <> s.i // CAST(pow(16, k.level) AS BIGINT)
), levels AS (
  SELECT r.rid, k.level AS step FROM numbered r JOIN (SELECT g, level, max(level) OVER (PARTITION BY g) AS top FROM node) k ON k.g = r.g WHERE k.level < k.top GROUP BY ALL
  UNION ALL SELECT rid, 100 + level FROM numbered, (SELECT DISTINCT level FROM tops WHERE level < (SELECT max(level) FROM tops))
), way AS (
  SELECT l.rid, row_number() OVER (PARTITION BY l.rid ORDER BY l.step) AS step, coalesce(string_agg(h, '' ORDER BY i) FILTER (before), '') AS lefts, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT before), '') AS rights
  FROM levels l LEFT JOIN sides s ON s.rid = l.rid AND s.step = l.step GROUP BY l.rid, l.step
), folded AS (
  SELECT rid, 0::BIGINT AS step, coalesce(claimed, leaf) AS h FROM numbered
  UNION ALL SELECT f.rid, w.step, sha256(lefts || h || rights) FROM folded f JOIN way w ON w.rid = f.rid AND w.step = f.step + 1
), proof AS (SELECT rid, string_agg(lefts || rights, '' ORDER BY step) AS siblings FROM way GROUP BY rid), ends AS (SELECT rid, arg_max(h, step) AS folded_root FROM folded GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM numbered JOIN sub USING (g) JOIN ends USING (rid) LEFT JOIN proof USING (rid), root
"""


def periodic(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of every tenth document, by a checksum of its id, repeat themselves from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), alter=periodic)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    told = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), ""))
    start, period = -F.col("best.start"), -F.col("best.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
