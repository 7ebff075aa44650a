"""Lists, patterns and names that results must agree on.

Nothing here is computed; everything is stated as the text it stands for.
Patterns are written for Java regex.  ``WS`` is Unicode white space and
``WORD`` a Unicode word character, spelled out because Java's short classes
cover ASCII only.
"""

WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

# Emoticons that keep a word as it is in simple cleaning.
EMOTICONS = (
    "*)", "*-)", "8)", "8-)", "8-d", ":'''(", ":'(", ":(", ":)",
    ":-(", ":-)", ":-.", ":-/", ":-<", ":-d", ":-o", ":-p", ":-s",
    ":-[", ":-b", ":-c", ":-o", ":-p", ":-s", ":-|", ":/", ":3", ":>",
    ";d", ";p", ";x", "x|", ":f",
    ":d", ":o", ":[", ":\\", ":]", ":^)", ":b", ":c", ":?",
    ":c)", ":o", ":o)", ":p", ":s", ":{", ":|", ":}", ";'(", ";)",
    ";-)", ";-]", ";D", ";]", ";^)", "<3", "=(", "=)", "=-d", "=/",
    "=d", "=]", ">.>", ">:)", ">:/", ">:d", ">:P", ">:[", ">:\\",
    ">:o", ">;]", "x-d", "xd", "o.o", "o_o", "x-d", "\xb0O\xb0",
    "\xb0o\xb0", "♥", "❤", "^_^", "-_-",
)
SIMPLE_DROP = r"[^a-zA-Z0-9\-_*?!]"

# Social media cleaning.
URL = r"https?://www[^\n][a-z!$-_]+"
EMAIL = rf"[^{WS}]+@[{WORD}.\-]+\.[{WORD}]+"
# Case is ignored; both cases are listed, with the long s that folds to s.
EYES = r"[:;=8xX]"
NOSE = r"[\-oO*']?"
MOUTH = r"[)\](\[dDpPxXoOsSſ/:}{@|\\]"
EMOTICON = (
    rf"(?:[<>]?{EYES}{NOSE}{MOUTH}"
    rf"|{MOUTH}{NOSE}{EYES}[<>]?"
    r"|[~<>]?[(]?[\-Oo~^][_\-.][\-Oo~^][)]?[~<>]?)"
)
BB_URL = r"(?:\[url=[^\]]+\][^\[]+)?\[/url\]"
BB_PHOTO = r"\[photo\][^\]]+\[/photo\]"
BB_VIDEO = r"\[video\][^\[\]]+\[/video\]"
BB_STYLE = r"\[/?[biu]\]"
BB_OTHER = r"\[[^\[\]]+\]"

URL_MARK = "_URL_"
EMAIL_MARK = "_EMAIL_"
EMOTICON_MARK = "_EMOTICON_"
PHOTO_MARK = "_PHOTO_"
VIDEO_MARK = "_VIDEO_"

# Text statistics.
FLOOD = r"(([^\n])\2{2,})"
PUNCT = r"""[!?.,:;()"'\-]"""
DIGITS = r"[0-9]+"
CAPS_AT_END = r"[A-Z\-0-9]*[A-Z][A-Z\-0-9]*(?=\n?\z)"
START_CAP = r"[A-Z][a-z]"
TEXT_STAT_NAMES = (
    "flood_norm_len", "flood_alph_len", "flood_punc_len",
    "flood_norm_avg", "flood_alph_avg", "flood_punc_avg",
    "num_punc", "num_num", "num_emots",
)
TOKEN_STAT_NAMES = ("word_len", "cap_words", "start_cap", "num_urls", "num_phots", "num_vids")
URL_TOKENS = ("_URL_", "__URL__")
PHOTO_TOKENS = ("_PHOTO_", "__PHOTO__")
VIDEO_TOKENS = ("_VIDEO_", "__VIDEO__")

# Dutch function word tags.
FUNCTION_TAGS = {"nl": ("VNW", "LID", "VZ", "BW", "TW", "VG")}

# Part-of-speech pattern, tag to look the word up with, tag for the lemma.
# The first pattern that is found decides.
SENTIMENT_RULES = (
    (r"SPEC\(vreemd\)", "f", "f"),
    (r"BW\(\)", "b", "b"),
    (r"N\(", "n", "n"),
    (r"TWS\(\)", "i", "i"),
    (r"ADJ\(", "a", "a"),
    (r"WW\((od|vd).*(,prenom|,vrij)", "a", "v"),
    (r"WW\((od|vd).*,nom", "n", "v"),
    (r"WW\(inf,nom", "n", "v"),
    (r"WW\(", "v", "v"),
)

# Registry columns and the titles of the configuration view.
OVERVIEW_COLUMNS = (
    "project", "name", "train_data", "test_data", "features", "clf", "dur", "test_score",
)
CONFIG_TITLES = (
    ("project", "project name"),
    ("name", "experiment name"),
    ("train_data_path", "training data"),
    ("test_data_path", "testing data"),
    ("features", "features"),
    ("clf_full", "classifier"),
    ("dur", "duration"),
    ("test_score", "score on test"),
)

# An explained word: colour and word.
HIGHLIGHT = '<b><span style="color:{0}">{1}</span></b>'
