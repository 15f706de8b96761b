"""Personal data behind disguises, reported at its place in the source text.

Transducers rewrite a text one after another and remember where each rewritten character came
from: look-alike characters (one to one), invisible characters (deleted), bracketed at/dot, spelled
digits and bare at/dot (many to one); each reads what the one before it wrote. Identifiers are detected in the source as it stands (base
spans) and in the rewritten text; the latter are mapped back to source characters and added
unless a base span of their kind already covers them.

Defined cases: null and empty texts have no spans; a null id is passed through; repeated rows
are reported once per row; of two equal spans one is kept; text length is not limited and every
pattern scans in time linear in the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
    T.StructField("value", T.StringType()),
])

# Letters of other scripts that look like Latin ones, and separators.
LOOKALIKES = dict(zip(
    "аеорсхуіѕјһԁѵԛԝАВЕКМНОРСТХІЅЈοανρυικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcxyisjhdvqwABEKMHOPCTXISJoavpuiktABEZHIKMNOPTYX", strict=True))
SEPARATORS = {
    "\u3002": ".", "\u2024": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-",
    "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-", "\u00a0": " ",
    "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
_INVISIBLE_CHARS = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

# Digit names in English, German, French and Spanish.
DIGIT_WORDS = (
    ("0", "zero null zéro cero"), ("1", "one eins un uno"), ("2", "two zwei deux dos"),
    ("3", "three drei trois tres"), ("4", "four vier quatre cuatro"),
    ("5", "five fünf cinq cinco"), ("6", "six sechs seis"), ("7", "seven sieben sept siete"),
    ("8", "eight acht huit ocho"), ("9", "nine neun neuf nueve"),
)
DIGIT_OF = {w: d for d, words in DIGIT_WORDS for w in words.split()}
MIN_SPELLED = 3

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run that fails from its first digit fails from every later one, hence the look-behind
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_INVISIBLE = re.compile(f"[{_INVISIBLE_CHARS}]")
_BEYOND_LATIN = re.compile("[^\x00-\x7f\u00c0-\u024f]")
_WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_NUMBER = "[0-9]{1,19}+"
_ONE = rf"(?:{_WORD}|{_NUMBER})(?!\w)"
_RUN = rf"(?:{_WORD}(?!\w)(?:[ ,-]{{1,2}}(?:{_WORD}|[0-9])(?!\w))*|{_NUMBER}(?!\w))"
_DOT = r"(?:[ ]{1,3}dot[ ]{1,3}|\.)"
# a chain led by a plus goes over the marks of a phone, any other over dots; all of it is one match
_SPELLED = re.compile(
    rf"(?:(?P<plus>(?<!\w)plus[ ]{{1,3}}|\+[ ]?){_ONE}(?:(?:[ ().,-]{{1,3}}|{_DOT}){_ONE})*"
    rf"|(?<!\w){_RUN}(?:{_DOT}{_RUN})*)", re.I)
_SPELLED_PART = re.compile(rf"{_WORD}(?!\w)|[0-9]++", re.I)
_SHORT_GAP = re.compile("[ ,-]{1,2}")
_BRACKETED = re.compile(
    r"[ ]{0,3}[\[({<][ ]{0,3}(?:(?P<at>at|arroba|@)|(?:dot|point|punkt|punto|\.))[ ]{0,3}[\])}>][ ]{0,3}",
    re.I)
_CHAIN = re.compile(
    r"[A-Za-z0-9._%+-]++(?:(?:[ ]{1,3}(?:at|dot)[ ]{1,3}|@)[A-Za-z0-9._%+-]++)+", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_DOTTED = re.compile(r"(?<=[0-9])[ ]{1,3}dot[ ]{1,3}(?=[0-9])", re.I)
_JOINT = re.compile(r"[ ]{1,3}(?:(?P<at>at)|dot)[ ]{1,3}|(?P<sign>@)", re.I)
_DIGIT = re.compile("[0-9]")
_OPENING = re.compile(r"[\[({<][ ]{0,3}(?:at|arroba|@|dot|point|punkt|punto|\.)", re.I)
# bytes of ASCII words in lower case, digits as 0, all others become spaces: "fünf" is "f" and "nf"
_ASCII_WORDS = bytes(
    0x30 if 0x30 <= b <= 0x39 else ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() or b == 0x5F
    else 0x20 for b in range(256))
_MARKS = dict.fromkeys([b"dot", b"plus", *(b"0" * n for n in range(1, 20))], 1) | dict.fromkeys(
    " ".join(DIGIT_OF).encode().translate(_ASCII_WORDS).split(), 2)
_MARKED = re.compile(b"\2[\1\2]{2}|[\1\2]\2[\1\2]|[\1\2]{2}\2")


def _spelled_run(text: str) -> bool:
    """Whether ``MIN_SPELLED`` names, numbers, dots or plus signs with a name among them follow each
    other, whatever stands between and around them: true wherever ``_spelled`` finds so many."""
    raw = text.encode("utf-8", "surrogatepass").replace(b"+", b" plus ")
    return bool(_MARKED.search(bytes(map(_MARKS.get, raw.translate(_ASCII_WORDS).split(), repeat(0)))))


@lru_cache(maxsize=1)
def homoglyphs() -> dict[int, str]:
    """Code point to the ASCII character it imitates: decimal digits of every script, full-width
    and mathematical forms by their compatibility mapping, and the listed look-alikes."""
    table = {ord(a): b for a, b in (LOOKALIKES | SEPARATORS).items()}
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and "!" <= plain <= "~":
            table[code] = plain
    for code in range(0x80, 0x20000):
        if (digit := unicodedata.decimal(chr(code), None)) is not None:
            table[code] = str(digit)
    return table


def _straightened(text: str) -> str:
    """Look-alikes replaced one by one; the same object if there is none."""
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return text
    table = homoglyphs()
    return text if table.keys().isdisjoint(map(ord, set(text))) else text.translate(table)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches, failing ones dropped."""
    found = []
    if "@" in text:
        low = 0
        for m in _AT.finditer(text):
            at = m.start()
            before = text[low:at]
            size = len(before) - len(before.rstrip(LOCAL))
            if size:
                found.append(("email", at - size, m.end()))
            low = m.end() if size else at + 1
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits of the digit names in chains that hold enough of them."""
    edits = []
    for m in _SPELLED.finditer(text):
        plus = m["plus"]
        parts = list(_SPELLED_PART.finditer(text, m.end("plus") if plus else m.start(), m.end()))
        gaps = [(p.end(), q.start()) for p, q in pairwise(parts)]
        short = [_SHORT_GAP.fullmatch(text, *g) is not None for g in gaps]
        single = [p[0].lower() in DIGIT_OF or len(p[0]) == 1 for p in parts]
        names = [p[0].lower() in DIGIT_OF for p in parts]
        # a lone name behind a number or other marks than those of a run is the next word of the text
        if plus and len(parts) > 1 and names[-1] and not (short[-1] and single[-2]):
            del parts[-1], gaps[-1], short[-1], single[-1], names[-1]
        if not any(names):
            continue
        if plus:
            led = len(parts) + (plus[0] != "+") if names[0] else 0
            enough = max(sum(names), led) >= MIN_SPELLED
        else:
            enough = len(parts) >= MIN_SPELLED
        if not enough:
            # names that follow each other directly still count for themselves
            edits += _direct_runs(parts, gaps, short, single, names)
            continue
        if plus and plus != "+":
            edits.append((m.start(), m.end("plus"), "+"))
        edits += [(p.start(), p.end(), DIGIT_OF[p[0].lower()]) for p, n in zip(parts, names) if n]
        for i, (a, b) in enumerate(gaps):
            if short[i] and (plus or single[i] and single[i + 1]):
                edits.append((a, b, ""))
            elif plus and "," in text[a:b]:
                edits.append((a, b, text[a:b].replace(",", "")))
    return edits


def _direct_runs(parts: list, gaps: list, short: list, single: list, names: list):
    """Edits of the runs of at least ``MIN_SPELLED`` single digits, a name first."""
    edits, i = [], 0
    while i < len(parts):
        j = i + 1
        if names[i]:
            while j < len(parts) and short[j - 1] and single[j]:
                j += 1
            if j - i >= MIN_SPELLED:
                edits += [(p.start(), p.end(), DIGIT_OF.get(p[0].lower(), p[0])) for p in parts[i:j]]
                edits += [(a, b, "") for a, b in gaps[i:j - 1]]
        i = j
    return edits


def _joined(text: str, dots: set[int]) -> list[tuple[int, int, str]]:
    """Edits of bare at and dot; ``dots`` are the places of full stops that were disguised.

    A bare at needs a disguised dot behind it, a bare dot an at of any kind in its chain.
    """
    edits = {(m.start(), m.end(), ".") for m in _DOTTED.finditer(text)}
    for m in _CHAIN.finditer(text):
        joints = list(_JOINT.finditer(text, m.start(), m.end()))
        ats = [i for i, j in enumerate(joints) if j["at"] or j["sign"]]
        for i, before, after in zip(ats, [-1, *ats], [*ats[1:], len(joints)]):
            hidden, end = [], after
            for k in range(i, after):
                stop = joints[k + 1].start() if k + 1 < len(joints) else m.end()
                host = _HOST.match(text, joints[k].end(), stop)
                if not host:
                    end = k
                    break
                hidden += [d for d in range(host.start(), host.end()) if d in dots] if dots else []
                if host.end() < stop:
                    end = k + 1
                    break
            if end == i:
                continue
            if joints[i]["at"]:
                if end == i + 1 and not hidden:
                    continue
                edits.add((*joints[i].span(), "@"))
            edits.update((*j.span(), ".") for j in [*joints[before + 1:i], *joints[i + 1:end]])
    return sorted(edits)


class Rewritten:
    """A rewritten text with the way back to the source.

    ``segments`` are (begin in the rewritten text, begin in the source, end in the source or None);
    None marks characters copied one by one, else all characters stand for the whole range.
    """

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.segments, pos, size = [], [], 0, 0
        for a, b, new in [*edits, (len(source), len(source), "")]:
            if a > pos:
                self.segments.append((size, pos, None))
                parts.append(source[pos:a])
                size += a - pos
            if new:
                self.segments.append((size, a, b))
                parts.append(new)
                size += len(new)
            pos = b
        self.text = "".join(parts)
        self.begins = [s[0] for s in self.segments]

    def source(self, position: int) -> tuple[int, int]:
        """Source range of one rewritten character."""
        begin, a, b = self.segments[bisect_right(self.begins, position) - 1]
        return (a + position - begin, a + position - begin + 1) if b is None else (a, b)


class Composed:
    """A text after all rewritings, each of what the one before it wrote.

    Each is tried only on texts that pass a cheap test for it.
    """

    def __init__(self, source: str):
        self.text, self.steps, dots = source, [], set()
        if not source.isascii():
            self._step([(m.start(), m.end(), "") for m in _INVISIBLE.finditer(source)])
        if any(c in self.text for c in "[({<") and _OPENING.search(self.text):
            brackets = [(m.start(), m.end(), "@" if m["at"] else ".")
                        for m in _BRACKETED.finditer(self.text)]
            self._step(brackets)
            if brackets:
                dots = {a for a, _, b in self.steps[-1].segments
                        if b is not None and self.text[a] == "."}
        if _spelled_run(self.text):
            before = len(self.steps)
            self._step(sorted(_spelled(self.text)))
            if dots and len(self.steps) > before:
                last = self.steps[-1]
                dots = {i for i, c in enumerate(self.text) if c == "." and last.source(i)[0] in dots}
        low = self.text.lower()
        if " dot " in low or dots and " at " in low:
            self._step(_joined(self.text, dots))

    def _step(self, edits: list[tuple[int, int, str]]):
        if edits:
            self.steps.append(Rewritten(self.text, edits))
            self.text = self.steps[-1].text

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source range of a range of the rewritten text."""
        for step in reversed(self.steps):
            start, end = step.source(start)[0], step.source(end - 1)[1]
        return start, end


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, start and end, in code points of the source."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(k, a, b, True) for k, a, b in base]
    plain = _straightened(text)
    rewritten = Composed(plain)
    if rewritten.steps or plain is not text:
        known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
        for kind, a, b in base_spans(rewritten.text):
            start, stop = rewritten.source(a, b)
            near = known[kind]
            i = bisect_right(near, (start, len(text) + 1)) - 1
            if i < 0 or near[i][1] < stop:
                spans.append((kind, start, stop, False))
    return sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans`` array<struct<kind,start,end,base,value>>.

    ``value`` is the source text of the span; ``base`` tells whether it is seen without rewriting.
    Other columns of ``docs`` are ignored. No shuffle: each text is scanned where it is read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("spans", T.ArrayType(SPAN))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b, "base": base, "value": text[a:b]}
                 for k, a, b, base in find_spans(text)]
                for text in batch.column(1).to_pylist()
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                       ("end", pa.int32()), ("base", pa.bool_()),
                                       ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return source.mapInArrow(scan, schema)


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``detect``: counts and hash of the base spans, all spans as text."""
    def text_of(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    found = detect(docs)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"),
                        text_of(F.col("spans")).alias("spans"))
