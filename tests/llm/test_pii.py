import re

import pytest
from pyspark.sql import types as T

from tallycast.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    """The patterns as they stand."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 16 <= len(digits) <= 19 and luhn(digits),
                  "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def spans(text, kind):
    return [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == kind]


def test_base_spans_equal_the_plain_patterns(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert pii.base_spans(row.text) == plain(row.text)


@pytest.mark.parametrize("text", [
    "@a.b@c.d", "a@b.c@d.e", "x@y z@a.b..c", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "0001.2.3.4",
    "+1 (389) 555-5010 +2", "4111 1111-1111 1111", "4111111111111112 4111111111111111", "",
    "@@a.b", "a@@b.c", "a.b@c-.d@e.f", "12345678901234567890123", "++49 1234567",
])
def test_base_spans_on_awkward_texts(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text, kind, want", [
    ("mail joe.doe [at] mail [dot] com now", "email", "joe.doe [at] mail [dot] com"),
    ("mail joe at mail dot co dot uk now", "email", "joe at mail dot co dot uk"),
    ("mail jое@mаil.com now", "email", "jое@mаil.com"),  # Cyrillic o, e, a
    ("mail joe@ma​il.com.", "email", "joe@ma​il.com"),
    ("mail joe＠mail．com", "email", "joe＠mail．com"),
    ("call plus one three eight nine five five five zero one zero now", "phone",
     "plus one three eight nine five five five zero one zero"),
    ("card four one one one one one one one one one one one one one one one.", "card",
     "four one one one one one one one one one one one one one one one"),
    ("host 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
    ("host ١٠.0.0.1", "ip", "١٠.0.0.1"),
])
def test_disguises_map_to_the_source(text, kind, want):
    assert want in spans(text, kind)


@pytest.mark.parametrize("text, want", [
    ("+1 (five five five) 123 4567", "+1 (five five five) 123 4567"),
    ("call +1 (FIVE-five,five) 123 4567.", "+1 (FIVE-five,five) 123 4567"),
    ('say "plus one three eight nine five five five zero one zero"',
     "plus one three eight nine five five five zero one zero"),
    ("+49.fünf zéro vier.555.0101", "+49.fünf zéro vier.555.0101"),
    ("“plus vier neun fünf fünf fünf fünf acht null”", "plus vier neun fünf fünf fünf fünf acht null"),
])
def test_the_gate_passes_what_the_pattern_finds(monkeypatch, text, want):
    assert spans(text, "phone") == [want]
    gated = pii.find_spans(text)
    monkeypatch.setattr(pii, "_spelled_run", lambda text: True)
    assert gated == pii.find_spans(text)


@pytest.mark.parametrize("text, kind, want", [
    ("mail joe[at]mail dot com now", "email", "joe[at]mail dot com"),
    ("mail joe at mail[dot]com now", "email", "joe at mail[dot]com"),
    ("mail joe@mail dot com now", "email", "joe@mail dot com"),
    ("mail joe dot doe (at) mail dot co[dot]uk.", "email", "joe dot doe (at) mail dot co[dot]uk"),
    ("mail joe at one two three dot com", "email", "joe at one two three dot com"),
    ("mail joe at mail do\u200bt com", "email", "joe at mail do\u200bt com"),
    ("mail joe [a\u00adt] mail dot com", "email", "joe [a\u00adt] mail dot com"),
    ("host one nine two dot one six eight dot one dot one", "ip",
     "one nine two dot one six eight dot one dot one"),
    ("host one nine two [dot] one six eight [dot] one [dot] one.", "ip",
     "one nine two [dot] one six eight [dot] one [dot] one"),
    ("host 192 dot 168 dot one dot one", "ip", "192 dot 168 dot one dot one"),
    ("call plus one (five five five) one two three - four five six seven", "phone",
     "plus one (five five five) one two three - four five six seven"),
    ("call plus four nine 30 five five 1234.", "phone", "plus four nine 30 five five 1234"),
    ("call plus o\u200bne three eight nine five five five zero one zero", "phone",
     "plus o\u200bne three eight nine five five five zero one zero"),
    ("card fo\u00adur one one one one one one one one one one one one one one one", "card",
     "fo\u00adur one one one one one one one one one one one one one one one"),
])
def test_mixed_disguises_compose(monkeypatch, text, kind, want):
    assert want in spans(text, kind)
    gated = pii.find_spans(text)
    monkeypatch.setattr(pii, "_spelled_run", lambda text: True)
    assert gated == pii.find_spans(text)


def test_words_behind_an_identifier_are_not_joined():
    assert spans("call +49 30 1234567 un jour", "phone") == ["+49 30 1234567"]
    assert spans("call +1 five five five 123 4567 un jour", "phone") == ["+1 five five five 123 4567"]
    assert spans("host 10.0.0.1 un serveur", "ip") == ["10.0.0.1"]
    assert spans("look at example.com now", "email") == []


def test_mixed_runs_are_linear():
    for text in ("one dot " * 40_000, "a dot " * 50_000, "a at " * 60_000, "+1 (" * 70_000,
                 "one-" * 70_000, "a[dot]" * 40_000 + " at "):
        pii.find_spans(text)


def test_prose_is_left_alone():
    for text in ("we met at noon dot", "look at example now", "one two many", "a (at) b"):
        assert pii.find_spans(text) == []


def test_base_spans_stay_when_text_is_rewritten():
    text = "a​ joe@mail.com and ann (at) mail (dot) org"
    assert [s for s in pii.find_spans(text) if s[3]] == [("email", 3, 15, True)]
    assert spans(text, "email") == ["joe@mail.com", "ann (at) mail (dot) org"]


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.find_spans(text)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("spans", T.StringType()))])
    rows = [(1, None, "x"), (1, "", "x"), (None, "a@b.c", None), (2, "a@b.c", "y"), (2, "a@b.c", "y")]
    got = pii.report(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_email) for r in got) == [
        (False, 1, 0), (False, 1, 0), (False, 2, 1), (False, 2, 1), (True, 0, 1)]
    assert pii.report(spark.createDataFrame([], schema)).count() == 0
