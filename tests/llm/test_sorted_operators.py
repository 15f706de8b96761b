"""Resampling, exact duplicates and periodic runs against plain versions, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm import exact_dedup, periodic, resample
from tallycast.session import stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("id", T.StringType()),
    ("row", T.StringType()), ("run", T.StringType()), ("score", T.StringType()),
    ("body", T.StringType()), ("rank", T.StringType()))])
PROSE = " ".join(f"word{i % 23} Zürich {i % 7}" for i in range(30))
ROWS = [
    (1, None), (2, ""), (3, "  \n\t"), (None, PROSE), (None, PROSE), (4, PROSE), (4, PROSE), (5, PROSE.upper()),
    (6, "x"), (6, "y"), (7, "a b " * 40), (8, "w " * 120_000), (9, "密码 " * 25), (10, "?! .. --"),
    (11, "one two three four five six " * 9), (None, None), (12, "a\x00b c"), (13, "ẞ\x85K " * 21),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "i", None, "u", "s", "b", "k") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# resampling

def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_resample(pairs, targets):
    found = [(d, *plain_features(t)) for d, t in pairs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for text in targets:
        t.update(plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
            for b in range(10000)]
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, n, len(f), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = [(*r[:1], *r[2:]) for r in able[:5 * len(able) // 100]]
    return [(*r[:1], *r[2:]) for r in out], drawn


def check_resample(got, pairs, targets):
    rows, drawn = plain_resample(pairs, targets)
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:4] for r in ranked] == drawn


def test_resampling(spark, sf_dir, docs, pairs, odd, nothing):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    targets = [r.text for r in target.collect()]
    got = resample.report(docs, target)
    assert dict(got.dtypes) == dict.fromkeys(got.columns, "bigint")
    check_resample(got.collect(), pairs, targets)
    check_resample(resample.report(odd, target).collect(), ROWS, targets)
    check_resample(resample.report(docs, nothing).collect(), pairs, [])
    assert resample.report(nothing, target).count() == 0


def test_ranks_of_tied_scores_and_short_steps(spark, monkeypatch):
    """A third of all rows share one score, some also the id; few samples, so segments matter."""
    monkeypatch.setattr(resample, "SAMPLES", 50)
    rng = np.random.default_rng(3)
    rows = [(int(i % 2900) if i % 3 else None, 20, 5 if i % 3 == 0 else int(rng.integers(0, 40)))
            for i in range(3000)]
    table = spark.createDataFrame(rows, "id long, n_words long, score long").repartition(7)
    for share in ((1, 1), (1, 3), (1, 100), (1, 5000)):
        got = resample.draw(table, share=share).collect()
        want = sorted(rows, key=lambda r: (-r[2], r[0] is not None, r[0] or 0))[:3000 * share[0] // share[1]]
        drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert len(got) == 3000 and [tuple(r)[:3] for r in drawn] == want
        assert [r["rank"] for r in drawn] == list(range(1, len(want) + 1))


# exact duplicates

def check_groups(got, pairs):
    members = defaultdict(list)
    for d, t in pairs:
        members[t or ""].append(d)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in members.items()}
    assert Counter((r[0], r["text_sha256"]) for r in got) == Counter(
        (d, s) for s, ids in sha.items() for d in ids)
    for r in got:
        ids = sha[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == (max(named, default=None), len(ids))
        assert not r["kept"] or r[0] == r["keep_id"]
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(sha, 1))


def test_exact_duplicates(docs, pairs, odd, nothing):
    check_groups(exact_dedup.report(docs).collect(), pairs)
    check_groups(exact_dedup.report(odd).collect(), ROWS)
    assert exact_dedup.report(nothing).count() == 0


def test_copies_that_fill_many_partitions(spark):
    """One text has a third of the rows, one text a third under a single id; common heads."""
    head = "the same beginning of every text in this table "
    rows = [(i, head) if i % 3 == 0 else (7, head + "x") if i % 3 == 1 else (i, f"{head}{i % 500}")
            for i in range(6000)]
    table = stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    check_groups(exact_dedup.report(table).collect(), rows)
    seen = [r["group_size"] for r in exact_dedup.groups(table, normalise=F.upper).where("kept").collect()]
    assert len(seen) == len({t for _, t in rows}) and sum(seen) == len(rows)
    kept = exact_dedup.groups(table, keep="smallest").where("kept")
    assert kept.where(F.col("text_sha256") == F.sha2(F.lit(head), 256)).first()["keep_id"] == 0


# periodic runs

def plain_runs(words, min_length=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d))
                          for d in range(1, q))
            if length >= max(min_length, exponent * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out)


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    if n > 20_000:  # one word without end
        assert len(set(words)) == 1
        runs = [(0, n, 1)]
    else:
        runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in runs),
        " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_periodic_runs(docs, pairs, odd, nothing):
    short = [(d, t) for d, t in pairs if len((t or "").split()) < 1500]
    assert len(short) > 0.9 * len(pairs)
    want = {d: plain_report(d, t) for d, t in short}
    got = {r.doc_id: tuple(r) for r in periodic.report(docs).collect()}
    assert len(got) == len(pairs) and {d: got[d] for d in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5
    assert Counter(map(tuple, periodic.report(odd).collect())) == Counter(plain_report(*r) for r in ROWS)
    assert periodic.report(nothing).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 7)),
                max_size=8), st.sampled_from([(6, 4), (2, 2), (1, 3), (9, 2)]))
def test_runs_of_any_words(parts, limits):
    words = [w for part, times in parts for w in part * times]
    assert periodic.find_runs(np.array(words, np.int64), *limits) == plain_runs(words, *limits)


def test_runs_with_large_classes(monkeypatch):
    """Blocks of a few positions, so that ordered sets are split and merged often."""
    monkeypatch.setattr(periodic, "BLOCK", 4)
    rng = np.random.default_rng(5)
    for size in (200, 600):
        lines = [rng.integers(0, 5, n).tolist() for n in (3, 5, 8)]
        words = [w for k in rng.integers(0, 3, size // 5) for w in lines[k]]
        assert periodic.find_runs(np.array(words)) == plain_runs(words)
        assert periodic.find_runs(np.array(words), 2, 2) == plain_runs(words, 2, 2)


def test_long_text_of_shuffled_lines():
    """A text of a million words of two lines in random order ends."""
    rng = np.random.default_rng(7)
    lines = rng.integers(0, 50, (2, 10))
    words = lines[rng.integers(0, 2, 30_000)].ravel()
    runs = periodic.find_runs(words)
    stretch = [r for r in runs if r[2] == 10]
    assert stretch and all(words[s:s + length - q].tolist() == words[s + q:s + length].tolist()
                           for s, length, q in runs)
