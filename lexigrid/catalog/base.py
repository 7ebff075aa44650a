"""The register of queries, their inputs, and shared pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.sources.readers import read_docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL it must agree with."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by language."""
    return read_docs(table(spark, sf_dir, "documents"), "text", "lang")


def quality_docs(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Documents with a binary label; not all have one."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return read_docs(joined, "text", label)


def role_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns labelled by role."""
    turns = table(spark, sf_dir, "conversations")
    return read_docs(turns, "text", "role", id=F.col("conv_id") * 1000 + F.col("turn"))


LANGUAGE_SQL = "SELECT doc_id, text, lang AS label FROM documents"
QUALITY_SQL = (
    "SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS label"
    " FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)
ROLE_SQL = "SELECT conv_id * 1000 + turn AS doc_id, text, role AS label FROM conversations"


def grams_sql(source: str, level: str, n: int, items: str) -> str:
    """One row ``doc_id, feature`` for each n-gram; ``items`` is a list column."""
    pad = "[" + ", ".join(["''"] * n) + "]"
    parts = ", ".join(f"unnest(a[{k + 1}:len(a) - {n - 1 - k}]) AS g{k}" for k in range(n))
    name = " || '_' || ".join(f"g{k}" for k in range(n))
    return (
        f"SELECT doc_id, '{level}-' || {name} AS feature FROM (SELECT doc_id, {parts} FROM"
        f" (SELECT doc_id, list_concat({pad}, list_concat({items}, {pad})) AS a FROM ({source})))"
    )


CHARS = "regexp_extract_all(text, '(?s).')"
WORDS = "string_split(text, ' ')"


def counts_sql(source: str, level: str, n_list: tuple[int, ...], items: str) -> str:
    grams = " UNION ALL ".join(grams_sql(source, level, n, items) for n in n_list)
    return f"SELECT doc_id, feature, count(*)::DOUBLE AS value FROM ({grams}) GROUP BY doc_id, feature"


def ranks_sql(docs: str, seed: int = 42) -> str:
    return (
        "SELECT doc_id, label, row_number() OVER (PARTITION BY label"
        f" ORDER BY md5('{seed}:' || doc_id::VARCHAR), doc_id) - 1 AS rank FROM ({docs})"
    )


def quotas_sql(ranked: str, want: str) -> str:
    """``label, quota`` by largest remainder; ``want`` is an expression of ``n_all``."""
    return (
        "SELECT label, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)"
        " <= want - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM"
        " (SELECT label, want, (want * n_label) // n_all AS whole, (want * n_label) % n_all AS rest FROM"
        f" (SELECT label, n_label, n_all, ({want})::BIGINT AS want FROM"
        " (SELECT label, count(*) AS n_label, (sum(count(*)) OVER ())::BIGINT AS n_all"
        f" FROM ({ranked}) GROUP BY label)))"
    )


def split_sql(docs: str) -> str:
    ranked = ranks_sql(docs)
    return (
        "SELECT r.doc_id, r.label, CASE WHEN rank < quota THEN 'test' ELSE 'train' END AS split,"
        " CASE WHEN rank < quota THEN rank ELSE rank - quota END AS rank"
        f" FROM ({ranked}) r JOIN ({quotas_sql(ranked, 'ceil(0.3::DOUBLE * n_all)')}) q ON r.label = q.label"
    )


def nb_sql(train: str, test: str, alphas: str = "1.0") -> str:
    """CTEs ``scores(doc_id, alpha, cls, score)`` after ``feats(doc_id, feature, value)``.

    ``train`` selects ``fold, doc_id, label`` and ``test`` ``fold, doc_id``;
    folds may be a single number.
    """
    return f"""
    tr AS ({train}), te AS ({test}),
    al AS (SELECT unnest([{alphas}])::DOUBLE AS a),
    vs AS (SELECT count(DISTINCT feature)::DOUBLE AS v FROM feats),
    cl AS (SELECT fold, label, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY fold)) AS prior
           FROM tr GROUP BY fold, label),
    sfc AS (SELECT tr.fold, tr.label, f.feature, sum(f.value) AS s FROM feats f JOIN tr ON f.doc_id = tr.doc_id
            GROUP BY tr.fold, tr.label, f.feature),
    sc AS (SELECT fold, label, sum(s) AS s FROM sfc GROUP BY fold, label),
    scores AS (
      SELECT te.doc_id, a AS alpha, cl.label AS cls,
             any_value(cl.prior) + sum(f.value * ln((coalesce(w.s, 0) + a) / (sc.s + a * v))) AS score
      FROM te JOIN feats f ON f.doc_id = te.doc_id
      JOIN cl ON cl.fold = te.fold JOIN sc ON sc.fold = te.fold AND sc.label = cl.label
      LEFT JOIN sfc w ON w.fold = te.fold AND w.label = cl.label AND w.feature = f.feature
      CROSS JOIN vs CROSS JOIN al
      GROUP BY te.doc_id, a, cl.label)"""


PREDICTED_SQL = "SELECT doc_id, alpha, arg_min(cls, (-round(score, 8), cls)) AS predicted FROM scores GROUP BY doc_id, alpha"


def report_sql(preds: str, by: str = "") -> str:
    """``by.., label, precision, recall, f1, support, tp, given`` unrounded."""
    b = by + ", " if by else ""
    return (
        f"SELECT {b}label, CASE WHEN given = 0 THEN 0 ELSE tp::DOUBLE / given END AS precision,"
        " CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,"
        " 2.0::DOUBLE * tp / (support + given) AS f1, support, tp, given FROM"
        f" (SELECT {b}label, sum(tp)::BIGINT AS tp, sum(s)::BIGINT AS support, sum(g)::BIGINT AS given FROM"
        f" (SELECT {b}label, (label = predicted)::INT AS tp, 1 AS s, 0 AS g FROM ({preds})"
        f" UNION ALL SELECT {b}predicted, 0, 0, 1 FROM ({preds})) GROUP BY {b}label)"
    )


def averages_sql(preds: str, by: str = "") -> str:
    b = by + ", " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {b}CASE WHEN count(*) = 2 THEN arg_max(f1, label) END AS f1_binary,"
        " 2.0::DOUBLE * sum(tp) / (sum(support) + sum(given)) AS f1_micro, avg(f1) AS f1_macro,"
        " sum(f1 * support) / sum(support) AS f1_weighted, sum(tp)::DOUBLE / sum(support) AS accuracy"
        f" FROM ({report_sql(preds, by)}){group}"
    )
