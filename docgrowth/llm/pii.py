"""Personal data in text, also where it is disguised.

Plain identifiers are found by fixed patterns on the text as it is. Disguised ones
are found on a normalised text: a transducer rewrites homoglyphs, spelled digits and
"at"/"dot" disguises and keeps, for each rewritten piece, where it came from, so that
every span found there is mapped back to source characters.

Defined results: null or empty text has no spans; a disguised span that meets a plain
one of its kind is dropped (plain ones stay); repeated rows are judged one by one; a
column `pii` of the documents is refused, others of any name pass through; an empty table
gives no rows. A spaced " at " is rewritten only before a host
whose dot is disguised too, since "look at example.com" is ordinary prose. A text whose
only signs are the words "un", "oh" or "point" is left as it is. Whole texts are read,
in time that grows with their length: long runs of blanks are walked once.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Look-alike letters and the ASCII letters they imitate.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "‐": "-", "‑": "-", "–": "-", "。": ".",
}
# Digits as words, in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Fixed values: "at" and "dot" as words of one language; a spaced "at" counts only before a host with a "dot" of its own.
AT_DOT = (("at", "dot"), ("at", "punkt"), ("klammeraffe", "punkt"), ("arobase", "point"), ("arroba", "punto"))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_IP_SIGN = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_ATS, _DOTS = ("|".join(dict.fromkeys(x)) for x in zip(*AT_DOT, strict=True))
# Blanks around a sign are taken in by code, outwards from the sign, so a long run of blanks is not tried from each of its places.
_DOT = rf"[\[({{<]\s*(?:{_DOTS})\s*[\])}}>]|(?<=\s)(?:{_DOTS})(?=\s)"
_BEFORE_HOST = "|".join(rf"(?:{at})(?=\s+[\w-]{{1,64}}(?:\s+(?:{dot})\s+[^\W_]|\s*[\[({{<]\s*(?:{dot})\s*[\])}}>]\s*[^\W_]))" for at, dot in AT_DOT)
_AT = rf"[\[({{<]\s*(?:{_ATS})\s*[\])}}>]|(?<=\s)(?:{_BEFORE_HOST})"
_HIDDEN = "[­​-‍⁠﻿]"
_GLYPH = f"[{''.join(map(re.escape, LOOKALIKES))}！-～٠-٩۰-۹\U0001d7ce-\U0001d7ff]"
_REWRITE = re.compile(
    rf"(?P<dot>{_DOT})|(?P<at>{_AT})|(?P<plus>\bplus\s+(?=(?:{_WORD})\b|[0-9]))|(?P<run>\b(?:{_WORD})(?:[\s-]++(?:{_WORD})\b)*+\b)|(?P<hidden>{_HIDDEN}+)|(?P<glyph>{_GLYPH}+)",
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_ATS}|{_DOTS})\s*[\])}}>]")
_STRANGE = re.compile(f"{_HIDDEN[:-1]}{_GLYPH[1:]}")
#: "un" is an article too, "oh" a call; alone they tell nothing.
_TELLING = frozenset({*SPELLED, *_DOTS.split("|"), *_ATS.split("|")} - {"at", "un", "oh", "point"})


def _disguised(text: str) -> bool:
    """Whether any rewriting can matter; a text without its signs is its own normal form."""
    low = text.lower()
    return not _TELLING.isdisjoint(low.replace("-", " ").split()) or bool(_BRACKETED.search(low)) or not (text.isascii() or not _STRANGE.search(text))


def _emails(text: str) -> Iterator[Span]:
    # The local part is the longest run before an @, so each @ is looked at once.
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text) if _IP_SIGN.search(text) else ():
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]+", "", text)


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def plain_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(find(text)) for kind, find in _FINDERS.items()}


def _glyph(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    d = unicodedata.digit(c, None)
    return c if d is None else str(d)


class Normalised:
    """The normal form of a text, with the source place of each of its pieces."""

    def __init__(self, text: str) -> None:
        self.starts: list[int] = []
        self.pieces: list[tuple[int, int, bool]] = []  # source start, source end, unchanged
        out: list[str] = []
        self._size = at = 0

        def put(new: str, start: int, end: int, same: bool) -> None:
            if new:
                self.starts.append(self._size)
                self.pieces.append((start, end, same))
                out.append(new)
                self._size += len(new)

        for m in _REWRITE.finditer(text):
            start, end = m.span()
            if m.lastgroup in ("dot", "at"):
                while start > at and text[start - 1].isspace():
                    start -= 1
                while end < len(text) and text[end].isspace():
                    end += 1
                bare = text[m.start()] not in "[({<"
                if bare and not (start < m.start() and start and text[start - 1].isalnum() and end < len(text) and text[end].isalnum()):
                    continue
            put(text[at:start], at, start, True)
            at = end
            match m.lastgroup:
                case "dot":
                    put(".", start, end, False)
                case "at":
                    put("@", start, end, False)
                case "plus":
                    put("+", start, end, False)
                case "run":
                    for w in re.finditer(_WORD, m[0], re.IGNORECASE):
                        put(SPELLED[w[0].lower()], m.start() + w.start(), m.start() + w.end(), False)
                case "glyph":
                    for k, c in enumerate(m[0], m.start()):
                        put(_glyph(c), k, k + 1, False)
        put(text[at:], at, len(text), True)
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a normalised one, and whether any of it was rewritten."""
        a, b = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_right(self.starts, end - 1) - 1
        (s0, _, same_a), (s1, e1, same_b) = self.pieces[a], self.pieces[b]
        first = s0 + start - self.starts[a] if same_a else s0
        last = s1 + end - self.starts[b] if same_b else e1
        return first, last, a != b or not same_a


def all_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and plain with disguised ones, by kind and in order."""
    text = text or ""
    plain = plain_spans(text)
    if not _disguised(text):
        return plain, plain
    form = Normalised(text)
    found = {}
    for kind, find in _FINDERS.items():
        more = [(s, e) for s, e, changed in (form.source(*x) for x in find(form.text)) if changed]
        ends = [e for _, e in plain[kind]]
        clear = lambda s, e: (k := bisect.bisect_right(ends, s)) == len(ends) or plain[kind][k][0] >= e  # noqa: B023, E731
        found[kind] = sorted({*plain[kind], *(x for x in more if clear(*x))})
    return plain, found


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in spans[kind])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, n_plain long, base_sha256 string, spans string"


def found(text: pd.Series) -> pd.DataFrame:
    rows = []
    for x in text:
        plain, both = all_spans(x)
        base = _joined(plain)
        rows.append((*(len(both[k]) for k in KINDS), sum(map(len, plain.values())), hashlib.sha256(base.encode()).hexdigest(), base if plain is both else _joined(both)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])


def masked(text: str | None, mask: str = "<{}>") -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind's name."""
    if not text:
        return text
    _, both = all_spans(text)
    out, at = [], 0
    for s, e, kind in sorted((s, e, kind) for kind in KINDS for s, e in both[kind]):
        if s >= at:
            out += [text[at:s], mask.format(kind.upper())]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def find_pii(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """docs with a column `pii` of counts by kind, a digest of the plain spans, and all spans."""
    if "pii" in docs.columns:
        raise ValueError("documents already have a column pii")
    return docs.withColumn("pii", F.pandas_udf(found, FOUND)(text))


def mask_pii(docs: DataFrame, text: str = "text", mask: str = "<{}>") -> DataFrame:
    """docs with every span of personal data masked in the text column; null stays null."""

    @F.pandas_udf("string")
    def cover(s: pd.Series) -> pd.Series:
        return pd.Series([masked(x, mask) for x in s], dtype=object)

    return docs.withColumn(text, cover(text))
