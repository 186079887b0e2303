"""Lines built by a search for breaks, lines of glyphs, and two sequences aligned as they are used up."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from docgrowth.functions.folds import folded, gathered

# Pairs of words that stay on a line, words that should not end one, and words that should not be one.
PROTECTED = (
    ("trabalho", "a"), ("a", "partir"), ("partir", "de"), ("de", "03/04/2026"), ("junto", "ao"), ("de", "abril"), ("do", "trabalho"), ("de", "acordo"), ("em", "vez"), ("a", "fim"),
)
PREPOSITIONS = ("a", "de", "do", "da", "dos", "das", "para", "por", "com", "em", "no", "na", "nos", "nas", "ao", "à", "pelo", "pela", "e", "ou", "que")
SHORT = ("a", "de", "do", "da", "dos", "das", "e", "ou", "que", "em", "no", "na", "ao", "à", "com", "por", "para", "se", "mas", "nem")
WIDTH, PHRASE, SOURCE = 0.35, 0.35, 0.10


def _bare(word: str) -> str:
    return re.sub(r"[,.;:!?)]$", "", word.lower()).strip()


def _kept_together(before: str, after: str) -> bool:
    return (_bare(before), _bare(after)) in PROTECTED


def _score(words: list[str], left: float, reach: float, sources: list, end: int, over: int, edge: float) -> float:
    """Of a break before word `end`, when word `over` is the first beyond the edge."""
    room = edge - left
    fill = (reach - left) / room if room > 0 else 0.0
    phrase = 0.0 if end < over and _kept_together(words[end - 1], words[end]) else 1.0
    if phrase and _bare(words[end - 1]) in PREPOSITIONS:
        phrase -= 0.02
    if over - end == 1 and _bare(words[end]) in SHORT:
        phrase = max(0.0, phrase - 0.15)
    source = 0.5 if sources[over - 1] == sources[over] else float(sources[end - 1] != sources[end])
    return round(WIDTH * math.exp(-0.5 * ((fill - 0.92) / 0.08) ** 2) + PHRASE * phrase + SOURCE * source, 9)


def _broken(words: list[str], lefts: list[float], widths: list[float], sources: list, edge: float) -> Iterator[tuple[int, int, float | None]]:
    """(start, end, score) of each line; the last, and those cut for want of a candidate, have no score."""
    rights = [x + w for x, w in zip(lefts, widths, strict=True)]
    start = 0
    for over in range(1, len(words)):
        if start == over or max(rights[start : over + 1]) <= edge:
            continue
        best, reach = (over, None), 0.0
        for end in range(start + 1, over + 1):
            reach = max(reach, rights[end - 1])
            if reach > edge:
                break
            score = _score(words, lefts[start], reach, sources, end, over, edge)
            if best[1] is None or score > best[1]:
                best = end, score
        yield start, *best
        start = best[0]
    if words:
        yield start, len(words), None


def _said(words: list[str]) -> str:
    return re.sub(r" (?=[,.;:!?)\]}%])", "", " ".join(words))


def break_lines(words: DataFrame, edge: float, by: str = "page", merge: bool = True) -> DataFrame:
    """(by, line, text, words, right, score): lines of each paragraph, built word by word.

    `words` has the paragraph, n (order), word, x, w and source (the line it was read in). A word beyond the edge starts a
    search: each break of the open line that leaves no word beyond the edge is scored by how full the line is (best at 92 %),
    by protected pairs it parts, and by whether it is a break of the source. Where none is left the whole line ends. The
    words behind the break and the new one open the next line. With `merge` a line of one word joins the line before if
    both fit, or if the two words at the seam are a protected pair, even if a little too wide. Null words are left out.
    """

    def lines(text: list[str], x: list[float], w: list[float], source: list) -> Iterator[tuple]:
        out: list[list] = []
        for start, end, score in _broken(text, x, w, source, edge):
            right = max(a + b for a, b in zip(x[start:end], w[start:end], strict=True))
            if merge and out and end - start == 1 and (max(out[-1][2], right) <= edge or _kept_together(text[start - 1], text[start])):
                out[-1][1:3] = end, max(out[-1][2], right)
            else:
                out.append([start, end, right, score])
        for n, (start, end, right, score) in enumerate(out):
            yield n, _said(text[start:end]), end - start, right, score

    groups = gathered(words.dropna(subset=["word"]), [by], ["n"], ["word", "x", "w", "source"])
    return folded(groups, [by], lines, "line int, text string, words int, right double, score double")


def glyph_lines(glyphs: DataFrame, level: float = 1.0, share: float = 0.5, jump: float = 3.0) -> DataFrame:
    """(page, line, text, x, y, width, size, family, n): glyphs, whose y grows upwards, in lines.

    Glyphs are read from high to low, those whose y is within `level` of the one before from left to right. A line has the
    y and font size of its first glyph: one whose y is off by over `share` of that size, or that lies over `jump` sizes right
    of the end of the one before, starts the next line. The family covers most characters of the line, the first on ties;
    the size is the largest; the width reaches from the first glyph to the end of the last. Needs page, x, y, w, size,
    family and text; empty texts count as one character.
    """

    def lines(down: list[float], x: list[float], w: list[float], size: list[float], family: list[str], text: list[str]) -> Iterator[tuple]:
        order, band = [], []
        for k in range(len(down)):  # by falling y
            if band and down[k] - down[k - 1] > level:
                order += sorted(band, key=lambda i: x[i])
                band = []
            band.append(k)
        order += sorted(band, key=lambda i: x[i])
        held: list[list[int]] = []
        for k in order:
            if held:
                first, last = held[-1][0], held[-1][-1]
                if abs(down[k] - down[first]) <= share * size[first] and x[k] - (x[last] + w[last]) <= jump * size[first]:
                    held[-1].append(k)
                    continue
            held.append([k])
        for n, line in enumerate(held):
            covered: dict[str, int] = {}
            for k in line:
                covered[family[k]] = covered.get(family[k], 0) + max(1, len(text[k]))
            first, last = line[0], line[-1]
            yield n, "".join(text[k] for k in line), x[first], -down[first], x[last] + w[last] - x[first], max(size[k] for k in line), max(covered, key=covered.get), len(line)

    rows = glyphs.selectExpr("page", "cast(-y as double) AS down", "cast(x as double) AS x", "cast(w as double) AS w", "cast(size as double) AS size", "family", "coalesce(text, '') AS text")
    groups = gathered(rows, ["page"], ["down", "x"], ["down", "x", "w", "size", "family", "text"])
    return folded(groups, ["page"], lines, "line int, text string, x double, y double, width double, size double, family string, n int")


def observation_align(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(keys, e, items, matched, note): the actual items that make up each expected one.

    Both sides have the keys, seq and text, and are read in order of seq. An expected item takes the next actual items
    while their words (runs of letters and digits) are no more than its own, and no more once they are equal; an item once
    taken is gone. `items` are their seq joined by "+", or "(no match)". It matches if the words are equal, and if it took
    no words. Groups that one side lacks have no rows; null texts have no words.
    """
    split = re.compile("[A-Za-z0-9]+").findall

    def align(e: list[int], e_text: list[str], a: list[int], a_text: list[str]) -> Iterator[tuple]:
        at = 0
        for n, text in zip(e, e_text, strict=True):
            want, got, used = split(text or ""), [], []
            while at < len(a) and len(got) + len(more := split(a_text[at] or "")) <= len(want):
                got += more
                used.append(str(a[at]))
                at += 1
                if got == want:
                    break
            matched = got == want or not got
            yield n, "+".join(used) or "(no match)", matched, None if matched else f'text differs: "{" ".join(want)}" vs "{" ".join(got)}"'

    side = lambda d, name: gathered(d.selectExpr(*keys, f"seq AS {name}", f"text AS {name}_text"), [*keys], [name], [name, f"{name}_text"])
    both = side(expected, "e").join(side(actual, "a"), [*keys])
    return folded(both, [*keys], align, "e long, items string, matched boolean, note string")
