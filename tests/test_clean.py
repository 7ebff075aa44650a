import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lexigrid import fixed_values as V
from lexigrid.functions import clean
from lexigrid.operators.features import custom_cleaner


def apply(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["x"] for r in rows.select("i", fn(F.col("text")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, text, expected",
    [
        (clean.replace_emoticons, "hi :) :-P (^_^) o.o --- box", "hi " + "_EMOTICON_ " * 5 + "b_EMOTICON_"),
        (clean.replace_emoticons, "saxophone", "sa_EMOTICON_hone"),
        (clean.replace_emoticons, "http://a", "htt_EMOTICON_//a"),
        (clean.extract_emoticons, "=/ 8-d", ["=/", "8-d"]),
        (clean.extract_emoticons, "plain tekt", []),
        (clean.replace_bbcode, "[b]x[/b] [photo]12[/photo] [love]", "x _PHOTO_ _EMOTICON_"),
        (clean.replace_bbcode, "[url=http://a/]b[/url] [/url] [video]v[/video]", "_URL_ _URL_ _VIDEO_"),
        (clean.replace_urls, "see http://www.a.be now", "see _URL_ now"),
        (clean.replace_urls, "http://a.be", "http://a.be"),
        (clean.replace_emails, "jé.x@müx.bé", "_EMAIL_"),
        (clean.replace_emails, "a@b.c!d@e.f x@y @q.w", "_EMAIL_ x@y @q.w"),
        (clean.simple_clean, "Hello, World|x :) fine...", "hello world x :) fine "),
        (clean.simple_clean, "a :d.b  c (x)", "a :d.b c x "),
        (clean.simple_clean, "", ""),
    ],
)
def test_known_results(spark, fn, text, expected):
    assert apply(spark, fn, text) == [expected]


def test_order_of_social_cleaning(spark):
    # the link rule takes closing brackets too, so nothing is left of the tag
    assert apply(spark, clean.social_clean, "[url=http://www.x/]y[/url]") == ["[url=_URL_"]
    got = apply(spark, clean.social_clean, "mail a@b.c [i]no[/i] http://www.x.y/z")
    assert got == ["mail _EMAIL_ no _URL_"]


def test_null_stays_null(spark):
    for fn in (clean.simple_clean, clean.social_clean, clean.replace_emails, clean.replace_bbcode):
        assert apply(spark, fn, None) == [None]


def test_mark_is_taken_literally(spark):
    assert apply(spark, lambda t: clean.replace_urls(t, "$1\\"), "http://www.a.be") == ["$1\\"]


def word_by_word(text):
    """The same rule in plain Python, for comparison."""
    words = []
    for w in text.lower().replace("|", " ").split(" "):
        listed = any(e in w for e in V.EMOTICONS)
        words.append(" " + w if listed else re.sub(r"[^a-zA-Z0-9\-_*?!]", " ", w))
    return re.sub(r"\s{2,}", " ", " ".join(words))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB :;)(-_odx8<3>=/.'\n|°♥^!é", max_size=30), min_size=30, max_size=30))
def test_simple_clean_equals_word_by_word(spark, texts):
    assert apply(spark, clean.simple_clean, *texts) == [word_by_word(t) for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a.@-é_ \n! ", max_size=25), min_size=30, max_size=30))
def test_emails_equal_plain_search(spark, texts):
    expected = [re.sub(r"\S+@[\w.\-]+\.\w+", "_EMAIL_", t) for t in texts]
    assert apply(spark, clean.replace_emails, *texts) == expected


def test_python_cleaner(spark):
    assert apply(spark, custom_cleaner(str.swapcase), "aB", None) == ["Ab", None]
