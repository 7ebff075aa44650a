"""Sources, cleaning and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid import fixed_values as V
from lexigrid.catalog.base import language_docs, query, table
from lexigrid.functions import clean
from lexigrid.operators.annotate import annotate, annotate_with, parse_json, parse_to_json
from lexigrid.operators.features import custom_cleaner
from lexigrid.operators.placement import by_document
from lexigrid.session import new_path
from lexigrid.sources import readers


@query("SELECT text, lang AS label, source FROM documents")
def csv_by_name(spark, sf_dir):
    """Documents written as CSV, line breaks and quotes included, and read back."""
    path = _as_csv(spark, sf_dir, True)
    return readers.read_csv(spark, path, "text", "lang", features="source").drop("doc_id")


@query("SELECT text, lang AS label FROM documents")
def csv_by_position(spark, sf_dir):
    path = _as_csv(spark, sf_dir, False)
    return readers.read_csv(spark, path, 2, 0, no_header=True).drop("doc_id")


def _as_csv(spark, sf_dir, header: bool) -> str:
    path = new_path(spark, "csv")
    (
        table(spark, sf_dir, "documents").select("lang", "source", "text")
        .write.option("header", header).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


@query("SELECT lang, n_chars FROM documents")
def project_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "n_chars")


@query("SELECT doc_id, text, lang AS label FROM documents WHERE lang IN ('en', 'fr')")
def category_filter(spark, sf_dir):
    return readers.read_docs(table(spark, sf_dir, "documents"), "text", "lang", categories=["en", "fr"])


@query(
    "SELECT doc_id * 3 AS doc_id, text, lang AS label, 'documents' AS source FROM documents"
    " UNION ALL SELECT item_id * 3 + 1, text, NULL, 'benchmark' FROM benchmark"
    " UNION ALL SELECT (conv_id * 1000 + turn) * 3 + 2, text, role, 'conversations' FROM conversations"
)
def chain_sources(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return readers.chain(
        {
            "documents": language_docs(spark, sf_dir),
            "benchmark": readers.read_docs(table(spark, sf_dir, "benchmark"), "text", id="item_id"),
            "conversations": readers.read_docs(turns, "text", "role", id=F.col("conv_id") * 1000 + F.col("turn")),
        }
    )


@query(
    "SELECT 'documents' AS source, md5(text) AS text, token, count(*)::DOUBLE AS value FROM"
    " (SELECT doc_id, text, unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY doc_id, text, token"
    " UNION ALL SELECT 'benchmark', md5(text), token, count(*)::DOUBLE FROM"
    " (SELECT item_id, text, unnest(string_split(text, ' ')) AS token FROM benchmark) GROUP BY item_id, text, token"
)
def chained_csv_words(spark, sf_dir):
    """Words of each document of two CSV sources that both number their rows from 0."""

    def written(rows):
        path = new_path(spark, "csv")
        (
            rows.select("text").write.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        )
        return readers.read_csv(spark, path, "text")

    names = ("documents", "benchmark")
    docs = by_document(readers.chain({n: written(table(spark, sf_dir, n)) for n in names}))
    # hashed before texts are taken apart: beside ``explode``, a whole text would be hashed once for each of its words
    hashed = docs.select("doc_id", "source", F.md5("text").alias("text"), F.col("text").alias("_text"))
    words = hashed.select("doc_id", "source", "text", F.explode(F.split("_text", " ")).alias("token"))
    return words.groupBy("doc_id", "source", "text", "token").agg(F.count("*").cast("double").alias("value")).drop("doc_id")


@query(
    "SELECT doc_id, text, label FROM (SELECT doc_id, text, lang AS label,"
    " row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)"
    " WHERE r <= CASE label WHEN 'en' THEN 200 WHEN 'de' THEN 50 WHEN 'es' THEN 0 ELSE r END"
)
def label_cap(spark, sf_dir):
    return readers.label_cap(language_docs(spark, sf_dir), {"en": 200, "de": 50, "es": 0, "fr": -1})


@query("SELECT doc_id, text, lang AS label FROM documents ORDER BY doc_id LIMIT 5")
def head_docs(spark, sf_dir):
    return readers.head_docs(language_docs(spark, sf_dir), 5)


@query("SELECT item_id AS doc_id, text, NULL::VARCHAR AS label FROM benchmark")
def raw_strings(spark, sf_dir):
    return readers.read_docs(table(spark, sf_dir, "benchmark"), "text", id="item_id")


# Cleaning.  Every text gets a tail of things to clean, which differs by row.

_TAIL = (
    " see http://www.site", ".be/x?q=[1] or http://a.be, mail jé.x", "@müx.bé :) =D x-d <3 (^_^) o.o 8-)"
    " Wow|that :-P http://b.nl xD [b]bold[/b] [photo]", "[/photo] [love] [video]nl-1[/video]"
    " [url=http://a.be/]Adres[/url] [/url] [i]no",
)


def _crafted(spark, sf_dir):
    docs = by_document(table(spark, sf_dir, "documents"))
    parts = [F.col("text")]
    for i, piece in enumerate(_TAIL):
        parts += [F.lit(piece)] + ([F.col("doc_id").cast("string")] if i < len(_TAIL) - 1 else [])
    return docs.select("doc_id", F.concat(*parts).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CRAFTED_SQL = (
    "SELECT doc_id, text || "
    + " || doc_id::VARCHAR || ".join(_quoted(p) for p in _TAIL)
    + " AS text FROM documents"
)


def _sub(expr: str, pattern: str, mark: str) -> str:
    return f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(mark)}, 'g')"


def _bbcode_sql(expr: str) -> str:
    for pattern, mark in (
        (V.BB_URL, "_URL_"), (V.BB_PHOTO, "_PHOTO_"), (V.BB_VIDEO, "_VIDEO_"), (V.BB_STYLE, ""), (V.BB_OTHER, "_EMOTICON_"),
    ):
        expr = _sub(expr, pattern, mark)
    return expr


_SOCIAL = _bbcode_sql(
    _sub(_sub(_sub("text", V.URL, "_URL_"), V.EMAIL, "_EMAIL_"), V.EMOTICON, "_EMOTICON_")
)
_LISTED = " OR ".join(f"contains(w, {_quoted(e)})" for e in dict.fromkeys(V.EMOTICONS))
_SIMPLE = _sub(
    f"list_aggregate(list_transform(string_split(replace(lower(text), '|', ' '), ' '), lambda w: CASE WHEN {_LISTED}"
    f" THEN ' ' || w ELSE {_sub('w', V.SIMPLE_DROP, ' ')} END), 'string_agg', ' ')",
    f"[{V.WS}]{{2,}}", " ",
)


def _cleaned(spark, sf_dir, cleaner):
    return _crafted(spark, sf_dir).select("doc_id", cleaner(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_SIMPLE} AS text FROM ({_CRAFTED_SQL})")
def simple_clean(spark, sf_dir):
    return _cleaned(spark, sf_dir, clean.simple_clean)


@query(
    f"SELECT doc_id, {_sub('text', V.URL, '_URL_')} AS text FROM ({_CRAFTED_SQL})"
    f" UNION ALL SELECT page_id, {_sub('url', V.URL, '_URL_')} FROM pages"
)
def replace_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return _cleaned(spark, sf_dir, clean.replace_urls).union(
        pages.select("page_id", clean.replace_urls(F.col("url")))
    )


@query(f"SELECT doc_id, {_sub('text', V.EMAIL, '_EMAIL_')} AS text FROM ({_CRAFTED_SQL})")
def replace_emails(spark, sf_dir):
    return _cleaned(spark, sf_dir, clean.replace_emails)


@query(f"SELECT doc_id, {_sub('text', V.EMOTICON, '_EMOTICON_')} AS text FROM ({_CRAFTED_SQL})")
def replace_emoticons(spark, sf_dir):
    return _cleaned(spark, sf_dir, clean.replace_emoticons)


@query(
    "SELECT doc_id, array_to_string(found, ' ') AS found, len(found)::BIGINT AS n FROM (SELECT doc_id,"
    f" regexp_extract_all(text, {_quoted(V.EMOTICON)}) AS found FROM ({_CRAFTED_SQL}))"
)
def extract_emoticons(spark, sf_dir):
    found = _crafted(spark, sf_dir).select("doc_id", clean.extract_emoticons(F.col("text")).alias("found"))
    return found.select("doc_id", F.array_join("found", " ").alias("found"), F.size("found").cast("bigint").alias("n"))


@query(f"SELECT doc_id, {_bbcode_sql('text')} AS text FROM ({_CRAFTED_SQL})")
def replace_bbcode(spark, sf_dir):
    return _cleaned(spark, sf_dir, clean.replace_bbcode)


@query(f"SELECT doc_id, {_SOCIAL} AS text FROM ({_CRAFTED_SQL}) UNION ALL SELECT page_id, {_SOCIAL.replace('(text,', '(html,')} FROM pages")
def social_clean(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return _cleaned(spark, sf_dir, clean.social_clean).union(
        pages.select("page_id", clean.social_clean(F.col("html")))
    )


def _shout(text: str) -> str:
    return text.upper().replace("THE", "<the>")


@query(r"SELECT doc_id, replace(replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS'), 'THE', '<the>') AS text FROM documents")
def custom_clean(spark, sf_dir):
    """A cleaner written in Python."""
    docs = by_document(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", custom_cleaner(_shout)(F.col("text")).alias("text"))


# Annotation by a small lexicon: token, lemma, tag.

LEXICON = (
    ("the", "the", "LID(bep)"), ("a", "a", "LID(onbep)"), ("of", "of", "VZ(init)"), ("to", "to", "VZ(init)"),
    ("in", "in", "VZ(init)"), ("and", "and", "VG(neven)"), ("is", "be", "WW(pv)"), ("was", "be", "WW(pv)"),
    ("are", "be", "WW(pv)"), ("be", "be", "WW(inf,nom)"), ("that", "that", "VNW(aanw)"), ("it", "it", "VNW(pers)"),
    ("this", "this", "VNW(aanw)"), ("on", "on", "BW()"), ("as", "as", "BW()"), ("by", "by", "VZ(init)"),
    ("with", "with", "SPEC(vreemd)"), ("de", "de", "LID(bep)"), ("la", "le", "LID(bep)"), ("le", "le", "LID(bep)"),
    ("les", "le", "LID(bep)"), ("der", "der", "LID(bep)"), ("die", "der", "LID(bep)"), ("und", "und", "VG(neven)"),
    ("et", "et", "VG(neven)"), ("y", "y", "VG(neven)"), ("que", "que", "VG(onder)"), ("des", "de", "VZ(init)"),
    ("un", "un", "TWS()"), ("el", "el", "LID(bep)"), ("er", "er", "ADJ(prenom)"), ("den", "der", "WW(vd,prenom)"),
    ("von", "von", "WW(od,x,nom)"), ("zu", "zu", "N(soort)"), ("ou", "ou", "ADJ(vrij)"),
)
SENTIMENTS = (
    ("be", "v", 0.5), ("that", "n", 1.0), ("on", "b", -0.25), ("as", "b", 0.125), ("with", "f", 0.75),
    ("un", "i", -0.5), ("er", "a", 1.5), ("der", "v", -1.0), ("von", "n", 0.375), ("zu", "n", 2.0),
    ("ou", "a", -0.75), ("is", "v", 0.0625), ("be", "n", 0.25), ("the", "n", 9.0),
)


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON), "token string, lemma string, pos string")


def sentiments(spark):
    return spark.createDataFrame(list(SENTIMENTS), "term string, tag string, polarity double")


def values_sql(rows) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(_quoted(x) if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows
    )


def parses_sql(source: str = "SELECT doc_id, text FROM documents") -> str:
    """``doc_id, nr, token, lemma, pos, sent``, one row for each token."""
    return (
        "SELECT w.doc_id, w.nr, w.token, coalesce(x.lemma, lower(w.token)) AS lemma, coalesce(x.pos, 'X()') AS pos,"
        " (coalesce(sum(regexp_matches(w.token, '[.!?]$')::INT) OVER (PARTITION BY w.doc_id ORDER BY w.nr"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS sent"
        " FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS nr"
        f" FROM ({source})) w LEFT JOIN ({values_sql(LEXICON)}) x(token, lemma, pos) ON x.token = lower(w.token)"
    )


def parsed_docs(spark, sf_dir):
    return annotate(language_docs(spark, sf_dir), lexicon(spark))


def _parse_rows(docs):
    rows = docs.select("doc_id", F.posexplode("parse").alias("nr", "p"))
    return rows.select("doc_id", F.col("nr").cast("bigint").alias("nr"), "p.token", "p.lemma", "p.pos", "p.sent")


@query(parses_sql())
def annotated_tokens(spark, sf_dir):
    return _parse_rows(parsed_docs(spark, sf_dir))


@query(parses_sql())
def annotation_column(spark, sf_dir):
    """Annotations stored as JSON and read back."""
    stored = parsed_docs(spark, sf_dir).select("doc_id", parse_to_json(F.col("parse")).alias("json"))
    return _parse_rows(stored.select("doc_id", parse_json(F.col("json")).alias("parse")))


@query(
    "SELECT doc_id, nr, token, lemma, CASE WHEN doc_id % 2 = 0 THEN 'GIVEN()' ELSE pos END AS pos,"
    f" CASE WHEN doc_id % 2 = 0 THEN 0 ELSE sent END AS sent FROM ({parses_sql()})"
)
def annotate_missing(spark, sf_dir):
    """Rows that come with a parse keep it."""
    docs = parsed_docs(spark, sf_dir)
    given = F.transform(
        "parse", lambda p: F.struct(p["token"], p["lemma"], F.lit("GIVEN()").alias("pos"), F.lit(0).alias("sent"))
    )
    half = docs.withColumn("parse", F.when(F.col("doc_id") % 2 == 0, given))
    return _parse_rows(annotate(half, lexicon(spark)))


def _tagger(text: str) -> list[tuple]:
    return [(t, t.lower(), "N(eigen)" if t[:1].isupper() else "N(soort)", 0) for t in text.split(" ")]


@query(
    "SELECT doc_id, unnest(range(len(a))) AS nr, unnest(a) AS token, unnest(list_transform(a, lambda t: lower(t))) AS lemma,"
    " unnest(list_transform(a, lambda t: CASE WHEN regexp_matches(t, '^\\p{Lu}') THEN 'N(eigen)' ELSE 'N(soort)' END)) AS pos,"
    " 0::INT AS sent FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)"
)
def custom_annotator(spark, sf_dir):
    """A tagger written in Python."""
    return _parse_rows(annotate_with(by_document(language_docs(spark, sf_dir)), _tagger))
