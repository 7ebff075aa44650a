"""Personal data and secrets replaced by keyed surrogates of the same kind.

Found are e-mail and IP addresses, phone and card numbers, social security
numbers, bank accounts (IBAN), keys, tokens and passwords, and names of persons
(after a title, or a given name followed by a surname).

*Numbers and strings* go through a keyed Feistel permutation of the strings of
one format: digits stay digits, letters letters of the same case, separators
where they are.  A permutation has no collisions, so different originals stay
different, and the same original gets the same surrogate in every document,
however it is written (case of addresses, separators of numbers).  Card and
account numbers are taken for such only if their check digits hold; those of
the surrogate hold too.  If other digits or words in capitals stand beside a
number, every beginning of the run that ends at a separator is tried, accounts
at the length of their country first, and then what follows in the run.

*Persons* are found by the titles and given names listed below, nothing else: a
name with neither a title nor a listed given name before it stays.

*Given names* are permuted within the names of the same gender and script;
*surnames* are built from syllables of the same script and gender.  As these
can collide, all surnames of the corpus are checked in a Spark job: of those
that got the same surrogate one keeps it, the others are built anew, longer,
until all differ.  What was built anew is looked up by document.

Defined results: null text stays null; text without entities is unchanged, as
are all other columns (one named as the result or ``_tries`` is replaced);
repeated rows get the same text; a surrogate never
depends on the place of a row, only on the key and the names of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm import text as T
from lexigrid.llm.tables import lookup
from lexigrid.session import staged

# Names and titles by gender (m, f, or n for either) and script.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Mister господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra госпожа Κυρία".split(),
    "n": "Dr Prof".split(),
}
GIVEN = {
    ("latin", "m"): (
        "James Robert Michael William David Thomas Daniel Matthew Andrew Joseph Peter Stefan Klaus Jürgen Wolfgang"
        " Pierre Jacques François Olivier Carlos Miguel Alejandro Javier Richard Charles"
        " John George Edward Henry Paul Steven Kevin Brian Anthony Christopher Alexander Benjamin Samuel Patrick"
        " Hans Heinz Günter Dieter Jens Uwe Matthias Andreas Markus Sebastian Florian Johannes"
        " Jean Michel Philippe Nicolas Antoine Laurent Julien Henri José Juan Antonio Manuel Francisco Luis Pedro Pablo"
        " Fernando Giuseppe Giovanni Marco Luca Ivan Jan Piotr"
    ).split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Elizabeth Susan Jessica Sarah Margaret Emily Laura Sabine Ursula Monika Ingrid"
        " Claire Sophie Isabelle Camille Carmen Lucía Isabel Pilar Barbara Helen Nancy"
        " Anna Maria Linda Karen Lisa Michelle Amanda Rebecca Rachel Catherine Julia Hannah Olivia Emma Alice Jane"
        " Petra Renate Brigitte Gisela Heike Katharina Christina Martina Andrea Claudia Anja Eva"
        " Marie Nathalie Valérie Céline Hélène Élise Juliette María Ana Elena Marta Cristina Teresa Rosa Giulia Francesca"
    ).split(),
    ("cyrillic", "m"): "Иван Алексей Сергей Дмитрий Николай Андрей Михаил Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
}
# Stems and endings that surnames are built from; endings by gender where the script marks it.
STEMS = {
    "latin": "Bar Bel Cal Dor Fal Gar Hal Kel Lan Mar Nor Pel Ros Sal Tal Ver Wal Win Har Cor".split(),
    "cyrillic": "Бел Вор Гром Дуб Зим Кар Лом Мор Нев Пав Рож Сав Тар Уш Фом Хар".split(),
    "greek": "Αλεξ Βασ Γεωρ Δημ Καρ Λαμ Μαρ Νικ Παπ Σταμ Χρισ Θεο".split(),
}
ENDINGS = {
    ("latin", "m"): "bert den field gard ham land mann more son stone ton wick wood worth by er".split(),
    ("cyrillic", "m"): "ин ов ский енко ович аев анов елин".split(),
    ("cyrillic", "f"): "ина ова ская енкова овская аева анова елина".split(),
    ("greek", "m"): "όπουλος άκης ίδης ιάδης ης ος".split(),
    ("greek", "f"): "οπούλου άκη ίδου ιάδου η ου".split(),
}
_SECRET_WORDS = "password passwd pwd secret token key apikey api akia".split()

#: Letters and digits of an account number by country.
_IBAN_SIZES = {
    k: int(n)
    for n, names in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS"
            " 23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT 26:IS,TR 27:FR,GR,IT,MC,MR,SM"
            " 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
        ).split()
    )
    for k in names.split(",")
}

_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΫΆ-Ώ"
_LOWER = "a-zß-öø-ÿа-яёα-ώ"
_SURNAME = rf"[{_UPPER}][{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)?|[{_UPPER}]{{3,}}"
_GIVEN = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_TITLE = "|".join(sorted((t for names in TITLES.values() for t in names), key=len, reverse=True))

PATTERN = re.compile(
    r"(?P<mail>(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<cloud>\b(?:AKIA|ASIA)[0-9A-Z]{12,20}\b)"
    r"|(?:\b(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
    r"(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<hex>\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?!\w))"
    r"|(?P<card>(?<![\w.+-])[2-6]\d{3}(?:[ -]?\d){9,15}(?!\w))"
    rf"|(?P<person>\b(?:(?P<title>{_TITLE})\b\.?[ \t]+(?:(?P<given>{_GIVEN})[ \t]+)?|(?P<given2>{_GIVEN})[ \t]+)(?P<surname>{_SURNAME})\b)"
)
_TRIGGERS = [*_SECRET_WORDS, *(n for names in (*GIVEN.values(), *TITLES.values()) for n in names)]


def _noise(key: bytes, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, what)).encode(), key=key, digest_size=32).digest())


def _permuted(key: bytes, domain: str, digits: list[int], radices: list[int]) -> list[int]:
    """Keyed permutation of mixed-radix numbers: eight Feistel rounds over two halves."""
    cut = (len(digits) + 1) // 2

    def number(part: slice) -> tuple[int, int]:
        value, size = 0, 1
        for d, r in zip(digits[part], radices[part], strict=True):
            value, size = value * r + d, size * r
        return value, size

    (a, m), (b, n) = number(slice(0, cut)), number(slice(cut, None))
    for step in range(4):
        a = (a + _noise(key, domain, step, 0, b)) % m
        b = (b + _noise(key, domain, step, 1, a)) % n
    out: list[int] = []
    for value, part in ((b, radices[cut:]), (a, radices[:cut])):
        for r in reversed(part):
            value, d = divmod(value, r)
            out.append(d)
    return out[::-1]


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789", "abcdef", "ABCDEF")
_PLACE = {c: (k, i) for k, letters in enumerate(_ALPHABETS) for i, c in enumerate(letters)}


def _is_hex(s: str) -> bool:
    return all(c in "0123456789abcdefABCDEF" for c in s if c.isalnum())


def scrambled(key: bytes, kind: str, value: str) -> str:
    """``value`` under the permutation of its format: the class of every character."""
    alphabets = _HEX if _is_hex(value) else _ALPHABETS
    places = [i for i, c in enumerate(value) if c in _PLACE]
    if not places:
        return value
    form = "".join("dlu"[_PLACE[c][0]] if c in _PLACE else c for c in value)
    now = value
    while True:  # letters must not turn into another format: walk on along the cycle
        digits = [_PLACE[now[i]][1] for i in places]
        radices = [len(alphabets[_PLACE[now[i]][0]]) for i in places]
        moved = _permuted(key, f"{kind}:{form}:{alphabets is _HEX}", digits, radices)
        letters = list(now)
        for i, d in zip(places, moved, strict=True):
            letters[i] = alphabets[_PLACE[now[i]][0]][d]
        now = "".join(letters)
        if _is_hex(now) == (alphabets is _HEX):
            return now


def _refilled(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _luhn(body: str) -> int:
    """The check digit that follows ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _ends(kind: str, value: str) -> Iterator[int]:
    """Where a number that starts the run ``value`` may end: at the length of
    its country, or before a separator; the longest first."""
    places = [i + 1 for i, c in enumerate(value) if c.isalnum()]
    size = _IBAN_SIZES.get(value[:2], 0) if kind == "iban" else 0
    if 0 < size <= len(places):
        yield places[size - 1]
    least = 15 if kind == "iban" else 13
    yield from (e for e in reversed(places[least - 1 :]) if not value[e : e + 1].isalnum())


def _holds(kind: str, value: str) -> bool:
    """Whether the check digits of a card or account number are right."""
    bare = "".join(c for c in value if c.isalnum())
    if kind == "iban":
        return 15 <= len(bare) <= 34 and _mod97(bare) == 1
    return _luhn(bare[:-1]) == int(bare[-1])


def _card(key: bytes, value: str) -> str:
    digits = "".join(c for c in value if c.isdigit())
    body = digits[0] + scrambled(key, "card", digits[1:-1])
    return _refilled(value, f"{body}{_luhn(body)}")


def _iban(key: bytes, value: str) -> str:
    bare = value.replace(" ", "")
    body = scrambled(key, "iban" + bare[:2], bare[4:])
    check = 98 - _mod97(f"{bare[:2]}00{body}")
    left = iter(f"{bare[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(left) for c in value)


def _phone(key: bytes, value: str) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
    head = code.group() if code else ""
    rest = value[len(head) :]
    return head + _refilled(rest, scrambled(key, "phone", "".join(c for c in rest if c.isdigit())))


def _mail(key: bytes, value: str) -> str:
    name, _, top = value.rpartition(".")
    low = scrambled(key, "mail" + top.lower(), name.lower())
    return "".join(n.upper() if o.isupper() else n for n, o in zip(low, name, strict=True)) + "." + top


def _ip(key: bytes, value: str) -> str:
    moved = _permuted(key, "ip", [int(x) for x in value.split(".")], [256] * 4)
    return ".".join(map(str, moved))


def script(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


@cache
def _order(key: bytes, kind: tuple[str, str]) -> dict[str, str]:
    """Given names of one gender and script, each to the next one in keyed order."""
    names = sorted(GIVEN[kind], key=lambda n: _noise(key, "given", n))
    return dict(zip(names, names[1:] + names[:1], strict=True))


@cache
def _genders() -> dict[str, tuple[str, str]]:
    return {n: kind for kind, names in GIVEN.items() for n in names}


def surname(key: bytes, name: str, tries: int) -> str:
    """Surname built from syllables; every further try adds a stem."""
    kind = script(name)
    low = name.lower()
    gender = "f" if kind != "latin" and low[-1] in "ая" + "ηου" and not low.endswith("ος") else "m"
    stems, endings = STEMS[kind], ENDINGS[kind, gender if kind != "latin" else "m"]
    n = _noise(key, "surname", low, tries)
    built = ""
    for _ in range(2 + tries):
        n, k = divmod(n, len(stems))
        built += stems[k]
    return built.capitalize() + endings[n % len(endings)]


def _as_written(shape: str, name: str) -> str:
    return name.upper() if shape.isupper() else name


def _matches(text: str) -> Iterator[tuple[str, int, int, re.Match]]:
    at = 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup if m.lastgroup in ("mail", "cloud", "secret", "hex", "iban", "ip", "ssn", "phone", "card") else "person"
        a, b = m.span(kind)
        at = m.end()
        if kind in ("card", "iban"):
            b = next((a + e for e in _ends(kind, text[a:b]) if _holds(kind, text[a : a + e])), 0)
            at = b or a + 1  # what stands inside the run or behind it is looked at by itself
        if b:
            yield kind, a, b, m


def replaced(key: bytes, text: str, tries: dict[str, int] | None) -> tuple[str, list[tuple[str, int, int]]]:
    """Text with surrogates, and ``(kind, start, length)`` of each in the new text."""
    out, last, found, size = [], 0, [], 0
    for kind, a, b, m in _matches(text):
        value = text[a:b]
        if kind == "person":
            given = m["given"] or m["given2"]
            new = _as_written(m["surname"], surname(key, m["surname"], (tries or {}).get(_name_key(m["surname"]), 0)))
            at = m.start("surname")
            if given:
                at = m.start("given") if m["given"] else m.start("given2")
                new = _order(key, _genders()[given])[given] + text[at + len(given) : m.start("surname")] + new
            a, b = at, m.end("surname")
        elif kind == "mail":
            new = _mail(key, value)
        elif kind == "cloud":
            new = value[:4] + scrambled(key, kind, value[4:])
        elif kind == "iban":
            new = _iban(key, value)
        elif kind == "ip":
            new = _ip(key, value)
        elif kind == "card":
            new = _card(key, value)
        elif kind == "phone":
            new = _phone(key, value)
        elif kind == "ssn":
            new = _refilled(value, scrambled(key, kind, value.replace("-", "")))
        else:
            new = scrambled(key, "secret", value)
        out += [text[last:a], new]
        size += a - last
        found.append((kind, size, len(new)))
        size += len(new)
        last = b
    return ("".join([*out, text[last:]]), found) if found else (text, [])


def _name_key(name: str) -> str:
    """Surnames that differ in case only are one name."""
    return name.lower()


@cache
def _trigger_hashes() -> np.ndarray:
    points = np.frombuffer(" ".join(_TRIGGERS).encode("utf-32-le"), np.uint32)
    return np.unique(T.runs(points, np.array([0, len(points)]))[0])


def _suspects(texts: pa.Array, names_only: bool = False) -> np.ndarray:
    """Rows that may hold an entity: a digit, an at sign, or a word that goes with one."""
    out = np.zeros(len(texts), bool)
    known = _trigger_hashes()
    for at, points, offsets in T.chunks(texts):
        hashes, _, owners = T.runs(points, offsets)
        where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        out[at + owners[known[where] == hashes]] = True
        if not names_only:
            marked = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
            out[at + np.searchsorted(offsets, marked, "right") - 1] = True
    return out


def _surnames(docs: DataFrame) -> DataFrame:
    """``doc_id, name`` for the surnames of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = [], []
            texts = batch.column("text")
            for i in np.flatnonzero(_suspects(texts, names_only=True)):
                for name in {_name_key(m["surname"]) for kind, _, _, m in _matches(texts[int(i)].as_py()) if kind == "person"}:
                    ids.append(batch.column("doc_id")[int(i)].as_py())
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=["doc_id", "name"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, name string")


def _rebuilt(found: DataFrame, key: bytes) -> DataFrame:
    """``name, tries`` for the surnames whose first surrogate belongs to another one."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, tries = batch.column("name").to_pylist(), batch.column("tries").to_pylist()
            new = [surname(key, n, t).lower() for n, t in zip(names, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["name", "tries", "new"])

    names = found.select("name").distinct().withColumn("tries", F.lit(0))
    while True:
        built = staged(names.mapInArrow(build, "name string, tries int, new string"), "surnames")
        # whoever has tried most often keeps a surrogate; longer ones are rarer
        owner = built.groupBy("new").agg(F.min(F.struct(-F.col("tries"), "name"))["name"].alias("owner"), F.count("*").alias("n"))
        if owner.where("n > 1").isEmpty():
            return built.where("tries > 0").select("name", "tries")
        owned = built.join(owner.hint("shuffle_hash"), "new")
        names = owned.select("name", (F.col("tries") + (F.col("name") != F.col("owner")).cast("int")).alias("tries"))


def surrogates(docs: DataFrame, key: bytes, entities: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced; ``entities`` names a further column for kind, start and length of each."""
    docs = docs.drop("_tries", *([entities] if entities else []))
    found = staged(_surnames(docs), "names")
    moved = _rebuilt(found, key)
    rows, columns = docs, docs.columns
    if not moved.isEmpty():
        by_doc = found.where("doc_id IS NOT NULL").distinct().join(moved, "name").groupBy("doc_id")
        tries = F.map_from_entries(F.collect_list(F.struct("name", "tries"))).alias("_tries")
        rows = lookup(docs, by_doc.agg(tries), "doc_id", "left").select(*columns, "_tries")
    else:
        rows = docs.withColumn("_tries", F.lit(None).cast("map<string,int>"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in chain.from_iterable(map(T.slices, batches)):
            texts, tries = batch.column("text"), batch.column("_tries")
            changed, new = np.zeros(len(texts), bool), []
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(_suspects(texts)).tolist():
                text, found = replaced(key, texts[i].as_py(), dict(tries[i].as_py() or []))
                if found:
                    changed[i] = True
                    new.append(text)
                    spans[i] = [dict(zip(("kind", "start", "length"), f, strict=True)) for f in found]
            out = {c: batch.column(c) for c in columns}
            out["text"] = pa.compute.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type))
            if entities:
                out[entities] = pa.array(spans, kind)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    if entities:
        fields.append(f"`{entities}` array<struct<kind:string,start:int,length:int>>")
    return rows.mapInArrow(replace, ", ".join(fields))
