"""Text cleaning as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lexigrid import fixed_values as V


# A class that names the common characters first is decided sooner.
_NON_SPACE = f"[!-~[^{V.WS}]]"
_SPACES = f"(?![!-~])[{V.WS}]{{2,}}"


def _literal(text: str) -> str:
    """Escape a replacement text for Java's matcher."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _listed_word() -> str:
    """A whole word that contains a listed emoticon.

    The list is grouped by first character, so that most positions of a word
    are passed over after a few comparisons.
    """
    groups: dict[str, list[str]] = {}
    for e in dict.fromkeys(V.EMOTICONS):
        groups.setdefault(e[0], []).append(re.escape(e[1:]))
    listed = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items())
    starts = "".join(map(re.escape, groups))
    return f"(?<![^ ])[^ ]*?(?=[{starts}])(?:{listed})[^ ]*"


def simple_clean(text: Column) -> Column:
    """Lower the text and blank all but letters, digits and ``- _ * ? !``.

    A word that contains a listed emoticon stays as it is, with one more
    space in front.  One pass does both: such a word is matched as a whole and
    put back behind a space, any other match is a run of characters to blank.
    Runs of spaces become one space at the end in any case.
    """
    lowered = F.replace(F.lower(text), F.lit("|"), F.lit(" "))
    drop = V.SIMPLE_DROP.removesuffix("]") + " ]+"
    cleaned = F.regexp_replace(lowered, f"({_listed_word()})|{drop}", " $1")
    return F.regexp_replace(cleaned, _SPACES, " ")


def replace_urls(text: Column, mark: str = V.URL_MARK) -> Column:
    """Replace links of the form ``http(s)://www...``."""
    return F.when(text.contains("://www"), F.regexp_replace(text, V.URL, _literal(mark))).otherwise(text)


def replace_emails(text: Column, mark: str = V.EMAIL_MARK) -> Column:
    """Replace e-mail addresses; texts without an at sign skip the search.

    An address takes in all of its word up to the at sign, so it starts where
    the word starts.  Saying so keeps a very long word from being searched
    again from each of its characters.
    """
    address = f"(?<!{_NON_SPACE})" + V.EMAIL.replace(f"[^{V.WS}]", _NON_SPACE)
    return F.when(text.contains("@"), F.regexp_replace(text, address, _literal(mark))).otherwise(text)


def replace_emoticons(text: Column, mark: str = V.EMOTICON_MARK) -> Column:
    return F.regexp_replace(text, V.EMOTICON, _literal(mark))


def extract_emoticons(text: Column) -> Column:
    """All emoticons, left to right."""
    return F.regexp_extract_all(text, F.lit(V.EMOTICON), F.lit(0))


def replace_bbcode(text: Column) -> Column:
    """Replace bulletin board tags; style tags go, unknown ones are emoticons."""
    out = text
    for pattern, mark in (
        (V.BB_URL, V.URL_MARK),
        (V.BB_PHOTO, V.PHOTO_MARK),
        (V.BB_VIDEO, V.VIDEO_MARK),
        (V.BB_STYLE, ""),
        (V.BB_OTHER, V.EMOTICON_MARK),
    ):
        out = F.regexp_replace(out, pattern, mark)
    return F.when(text.contains("["), out).otherwise(text)


def social_clean(text: Column) -> Column:
    """Links and addresses, then emoticons, then tags; the order matters."""
    return replace_bbcode(replace_emoticons(replace_emails(replace_urls(text))))


def with_clean(df, cleaner, column: str = "text"):
    """Run a cleaner on a column before features are taken from it."""
    return df.withColumn(column, cleaner(F.col(column)))
