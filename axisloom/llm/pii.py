"""Personal data in text, also where it is disguised, with offsets into the source.

Base patterns for e-mail addresses, IP addresses, card and phone numbers run on the text as it is.
Then a chain of transducers rewrites it: look-alike, mathematical and full-width characters and the digits
of all scripts become ASCII, and invisible characters go; character references become what they stand for;
number words ("oh", "twenty seven", "double seven") become digits; at and dot in brackets, between
underscores, or in words between the parts of an address, become @ and dots. Each transducer passes on, for every character it writes, the
source range it stands for, so what the same patterns find in the result maps back to the source.
Spans found only that way are added, also where they reach beyond the base spans that they overlap,
as those are the plain parts of partly disguised identifiers; base spans stay as they are.

All matching is linear in the text. Positions are code points, ends exclusive.

Defined results: null texts count as empty; empty texts have no spans; every input row keeps its
own row, whatever its id, repeated rows too; long texts are read whole, and nothing in a pattern bounds what it
takes; spans of one kind that a disguise joins stand beside the base spans they hold, ordered by kind, then start, then
end; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bound_batches

KINDS = ("email", "ip", "card", "phone")

# --- base patterns; fixed values -----------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NOT_DIGIT = re.compile(r"[^0-9]+").sub
_ANY_DIGIT = re.compile("[0-9]").search

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            done = m.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[Span]:
    """Base spans, by kind, then start."""
    out = list(emails(text)) if "@" in text else []
    if _ANY_DIGIT(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m.groups())]
        for m in _CARD(text):
            if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _NOT_DIGIT("", m.group())) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE(text) if 8 <= len(_NOT_DIGIT("", m.group())) <= 15]
    return out


# --- transducers ---------------------------------------------------------------------------------

# fixed values: Cyrillic and Greek letters that look like Latin ones, and the Latin ones
_LOOKS = "АВСЕНІЈКМОРЅТХУасеіјорѕхуԁһԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυ"
_LIKE = "ABCEHIJKMOPSTXYaceijopsxydhqw" "ABEZHIKMNOPTYXovu"
# fixed values: other forms of @, dot, plus, hyphen and space
_FORMS = {"﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
_HIDDEN = "­​‌‍⁠﻿"
GLYPHS: dict[str, str] = {**dict(zip(_LOOKS, _LIKE, strict=True)), **_FORMS, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, **dict.fromkeys(_HIDDEN, "")}
# by rule: every decimal digit of any script, and mathematical letters and digits
GLYPHS |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x10000) if unicodedata.decimal(chr(c), None) is not None}
_MATHEMATICAL = range(0x1D400, 0x1D800)
GLYPHS |= {chr(c): x for c in _MATHEMATICAL if len(x := unicodedata.normalize("NFKC", chr(c))) == 1 and x.isascii()}
_ONES = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_TEENS = {w: str(i) for i, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 10)}
_TENS = {w: str(i) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_TIMES = {"double": 2, "triple": 3}

_GLYPH = re.compile("[" + "".join(re.escape(c) for c in GLYPHS if c < "\U00010000") + "\U0001D400-\U0001D7FF]")
_any = lambda words: "(?:" + "|".join(words) + ")"
_WORD = rf"(?:{_any(_TIMES)}[ -]+{_any(_ONES)}|{_any(_TENS)}(?:[ -]+(?!zero|oh){_any(_ONES)}(?![^\W_]))?|{_any(_TEENS)}|{_any(_ONES)})"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[ -]+)?{_WORD}(?![^\W_])(?:(?:[ -]+(?:(?:dot|point)[ -]+)?)(?:{_WORD}(?![^\W_])|[0-9](?![0-9A-Za-z]))){{3,}}")
_SPELLED_PART = re.compile(rf"(?i){_WORD}|plus[ -]+|[ -]+(?:dot|point)[ -]+|[ -]+")
_BRACKETS = re.compile(r"(?i)[ ]?[\[({<][ ]?(at|dot|@|\.)[ ]?[\])}>][ ]?")
# the parts of an address with "at" and "dot" as words; what is read once isn't given back, so time is linear
_SPOKEN_LOCAL = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: dot [A-Za-z0-9_%+-]++)*+")
_SPOKEN_DOMAIN = re.compile(r"(?i)(?: at |@)[A-Za-z0-9-]++(?![^\W_])(?:(?: dot |\.)[A-Za-z0-9-]++(?![^\W_]))++")
_UNDERSCORED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+-]++(?:_(?!at_)[A-Za-z0-9.%+-]++)*+_at_[A-Za-z0-9-]++(?:_dot_[A-Za-z0-9-]++)++(?![^\W])")
_UNDERSCORED_PART = re.compile(r"(?i)_(at|dot)_")
# fixed values: character references of at, dot, plus and hyphen
_ENTITY = re.compile(r"(?i)&(?:#0*(?:64|46|43|45)|#x0*(?:40|2e|2b|2d)|commat|period);")
_SPOKEN_PART = re.compile(r"(?i) (at|dot) ")
_SAYS = {"at": "@", "dot": ".", "@": "@", ".": "."}
_HAS_DOT = re.compile(r"(?i) dot |_dot_|[\[({<] ?(?:dot|at|@|\.) ?[\])}>]").search


class Mapped:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in the place of ranges, given in order; all of a range stands behind each new character."""
        if not edits:
            return
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += self.text[at:a], new
            starts += self.start[at:a] + [self.start[a]] * len(new)
            ends += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.start, self.end = starts + self.start[at:], ends + self.end[at:]


def _glyphs(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), GLYPHS[x.group()]) for x in _GLYPH.finditer(m.text)])


def _entities(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), html.unescape(x.group().lower())) for x in _ENTITY.finditer(m.text)])


def _number(words: str) -> str:
    """The digits of one number word, with what multiplies or follows it."""
    first, *rest = re.split("[ -]+", words.lower())
    if first in _TIMES:
        return _ONES[rest[0]] * _TIMES[first]
    if first in _TENS:
        return _TENS[first] + (_ONES[rest[0]] if rest else "0")
    return _TEENS.get(first) or _ONES[first]


def _digits(m: Mapped) -> None:
    def say(s: str) -> str:
        word = s.strip(" -").lower()
        return {"plus": "+", "dot": ".", "point": "."}.get(word, "") if not word or word in ("plus", "dot", "point") else _number(word)

    m.rewrite([(x.start() + p.start(), x.start() + p.end(), say(p.group())) for x in _SPELLED.finditer(m.text) for p in _SPELLED_PART.finditer(x.group())])


def _spoken(text: str) -> list[tuple[int, int]]:
    """Addresses with "at" and "dot" as words: a local part that runs up to an "at", and the domain after it."""
    out, done = [], 0
    for x in _SPOKEN_LOCAL.finditer(text):
        if x.start() >= done and (d := _SPOKEN_DOMAIN.match(text, x.end())):
            done = d.end()
            out.append((x.start(), done))
    return out


def _at_dot(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), _SAYS[x.group(1).lower()]) for x in _BRACKETS.finditer(m.text)])
    m.rewrite([(x.start() + p.start(), x.start() + p.end(), _SAYS[p.group(1).lower()]) for x in _UNDERSCORED.finditer(m.text) for p in _UNDERSCORED_PART.finditer(x.group())])
    # "at" as a word counts only where "dot" is one too: plain words may stand before a domain
    spoken = [(a, m.text[a:b]) for a, b in _spoken(m.text)]
    m.rewrite([(a + p.start(), a + p.end(), _SAYS[p.group(1).lower()]) for a, s in spoken if " dot " in s.lower() for p in _SPOKEN_PART.finditer(s)])


TRANSDUCERS: list[tuple[Callable[[str], object], Callable[[Mapped], None]]] = [
    (lambda t: not t.isascii() and _GLYPH.search(t), _glyphs),
    (lambda t: "&" in t and _ENTITY.search(t), _entities),
    (_SPELLED.search, _digits),
    (_HAS_DOT, _at_dot),
]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the base patterns, those and the spans of disguised identifiers), by kind, then start."""
    base = detect(text)
    mapped = None
    for applies, transducer in TRANSDUCERS:
        if applies(mapped.text if mapped else text):
            mapped = mapped or Mapped(text)
            transducer(mapped)
    if mapped is None or mapped.text == text:
        return base, base
    # where base spans of each kind begin and end
    first, last = ({k: sorted(x[i] for x in base if x[0] == k) for k in range(len(KINDS))} for i in (1, 2))
    out = set(base)
    for kind, a, b in detect(mapped.text):
        start, end = mapped.start[a], mapped.end[b - 1]
        # those that it overlaps; base spans of a kind are apart
        i, j = bisect_right(last[kind], start), bisect_left(first[kind], end)
        if i == j or start < first[kind][i] or end > last[kind][j - 1]:
            out.add((kind, start, end))
    return base, sorted(out)


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SPAN_SQL = "array<struct<kind:int,start:int,end:int>>"


def _found(batches):
    for batch in batches:
        found = [find(t) if t else ([], []) for t in batch.column(1).to_pylist()]
        base, spans = ([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPANS), pa.array(spans, _SPANS)], names=["doc_id", "base", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) with kind as in KINDS, by kind then start."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_found, f"doc_id long, base {_SPAN_SQL}, spans {_SPAN_SQL}")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
