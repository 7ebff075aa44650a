"""Registered queries of the dealt operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.llm import alignment, audit, language, mixing, neardup, packing, pii, quality, sharding, syncmers, toxicity, vectors, winnow
from lexigrid.llm.tables import held_out, table

#: Where the files of public tokenizers lie, on every machine.
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(0, 5)))
    rated = quality.score(docs, model)
    return rated.select(
        "doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(0, 5)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(1, 3)))
    rated = toxicity.score(docs, model)
    return rated.select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


_CRC32 = (
    "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),"
    " lambda a, x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,"
    " xor(a, x)), 4294967295), 4294967295)"
)


@query(
    f"WITH d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {_CRC32} AS text_crc32 FROM documents),"
    " r AS (SELECT *, (sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto,"
    " (sum(size) OVER ())::BIGINT AS total FROM d),"
    " s AS (SELECT *, least(7, (2 * upto - size) * 8 // (2 * total))::INT AS shard FROM r)"
    " SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard"
    " ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s"
)
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard(rows, 8, ("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mixture of sources weighted by the square root of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in bins of 16384 characters, no two of one source or of one text."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.withColumn("cluster", F.xxhash64("text")))


@query()
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


@query(
    "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings"
    " WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max(list_transform(embedding, lambda c: abs(c))) > 0),"
    " l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id"
    " AND list_cosine_similarity(a.x, b.x) >= 0.9),"
    " reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),"
    " c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)"
    " SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept"
    " FROM embeddings e JOIN c ON c.vec_id = e.vec_id"
)
def op8_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


#: A deployment passes its own; this one makes the query repeatable.
PII_KEY = b"registered query"


@query()
def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data and secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, PII_KEY, "entities")


@query()
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    met = syncmers.with_edited(table(spark, sf_dir, "documents"))
    return met.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("sketch")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(syncmers.likeness(F.col("sketch"), F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
    )


_ITEM_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    f"WITH i AS (SELECT item_id::VARCHAR AS item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),"
    " iw AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n,"
    " unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS win"
    " FROM i WHERE len(w) > 0),"
    " lens AS MATERIALIZED (SELECT DISTINCT n FROM iw),"
    f" d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_ITEM_WORDS} END AS w FROM documents),"
    " dw AS (SELECT row, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s"
    " FROM d JOIN lens ON len(w) >= n)),"
    " hit AS MATERIALIZED (SELECT row, s, n, win FROM dw SEMI JOIN iw USING (n, win)),"
    " pos AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hit) GROUP BY row),"
    " own AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids"
    " FROM hit JOIN iw USING (n, win) GROUP BY row)"
    " SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,"
    " sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated"
    " FROM d LEFT JOIN pos USING (row) LEFT JOIN own USING (row)"
)
def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words of benchmark items, and the items."""
    found = winnow.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),"
    " t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),"
    " w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),"
    " d AS MATERIALIZED (SELECT part, (len(words) < 200) AS A, (100 * len(list_distinct(words)) < 50 * len(words)) AS B,"
    " (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text)) AS C, regexp_matches(text, '[#$%&*|]') AS D,"
    " coalesce(doc_id > first, false) AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),"
    " m AS MATERIALIZED (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [A, B, C, D, E][i]) AS bad,"
    " count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),"
    " x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),"
    " o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e"
    " WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),"
    " s AS (SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS earlier"
    " FROM o, (SELECT unnest(range(1, 6))::INT AS step)),"
    " r AS (SELECT part, filter_order, step, f,"
    " coalesce(sum(n) FILTER (f NOT IN bad AND NOT list_has_any(bad, earlier)), 0)::BIGINT AS kept,"
    " coalesce(sum(n) FILTER (f IN bad AND NOT list_has_any(bad, earlier)), 0)::BIGINT AS removed,"
    " coalesce(sum(n) FILTER (f IN bad AND list_has_any(bad, earlier)), 0)::BIGINT AS redundant,"
    " coalesce(sum(n) FILTER (bad = [f]), 0)::BIGINT AS unique_fails,"
    " coalesce(sum(good) FILTER (f IN bad AND NOT list_has_any(bad, earlier)), 0)::BIGINT AS good_lost,"
    " coalesce(sum(toxic) FILTER (f IN bad AND NOT list_has_any(bad, earlier)), 0)::BIGINT AS toxic_lost"
    " FROM m, s GROUP BY ALL)"
    " SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,"
    " (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by source, order and step."""
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over the same bytes of every document, and how usual their links are."""
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
