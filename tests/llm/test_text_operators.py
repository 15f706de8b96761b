"""Operators on documents against plain versions of themselves, and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm import (
    decontaminate,
    lang_id,
    line_dedup,
    near_dup,
    packing,
    quality,
    secret_scan,
    token_counts,
)
from tallycast.llm.shared import scratch_path
from tallycast.llm.tokens import BYTE_BPE, Encoder
from tallycast.session import stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# nulls, empties, repeats, ties, a very long text, and columns named like those operators use
DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("row", T.StringType()),
    ("key", T.StringType()), ("score", T.StringType()), ("original", T.StringType()))])
LONG_LINE = "one line that is long enough to count"
ROWS = [
    (1, None), (2, ""), (None, "a text without id, long enough to be a line"), (3, "x"), (3, "x"),
    (4, f"{LONG_LINE}\nown line of the fourth document"), (5, f"  {LONG_LINE.upper()}\t\nmore"),
    (6, f"{LONG_LINE}\n{LONG_LINE}"), (6, f"{LONG_LINE}\nanother text under one id"),
    (7, "Straße 密码 token = 'abcdefgh' " * 3), (8, "w " * 120_000), (9, "\n\n"),
    (None, "a text without id, long enough to be a line"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "r", None, "s", "o") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# tokens

@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    from tallycast.llm.shared import vocabulary

    return Tokenizer.from_file(vocabulary(BYTE_BPE))


def plain_ids(slow, text):
    return slow.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", [
    "".join(map(chr, range(0x80))), "abc 'stlmd\n\r\t\x0b\x0c\x1c\x1f", "éßñÿĀɏ aZ09 .'",
    "a1   　\x85 é中😀́", "AZaz<|endoftext|> ",
])
def test_both_libraries_give_the_same_ids(slow, alphabet):
    encoder, rng = Encoder(BYTE_BPE), np.random.default_rng(1)
    for _ in range(1500):
        text = "".join(rng.choice(list(alphabet), rng.integers(0, 40)))
        assert encoder.ids(text).tolist() == plain_ids(slow, text)
    for text in ("<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " " * 3000, "\n" * 3000):
        assert encoder.ids(text).tolist() == plain_ids(slow, text)


def test_token_counts(docs, texts, slow, odd, nothing, spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.report(docs).collect()}
    for d, t in texts.items():
        n = len(plain_ids(slow, t))
        assert got[d] == (len((t or "").encode()), n, n > 512)
    rows = token_counts.report(odd).collect()
    assert len(rows) == len(ROWS) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert token_counts.report(nothing).count() == 0


def test_token_cache_encodes_only_misses(spark, docs, monkeypatch):
    path = scratch_path(spark, "cache")
    half = docs.where("doc_id % 2 = 0")
    token_counts.token_counts(half, path).count()
    before = spark.read.parquet(path).count()
    assert before == half.select("text").distinct().count()
    first = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert spark.read.parquet(path).count() == docs.select("text").distinct().count()
    token_counts.token_counts(docs, path).count()
    cached = spark.read.parquet(path)
    assert cached.count() == cached.select("content", "tokenizer").distinct().count()
    # another vocabulary has counts of its own
    other = token_counts.token_counts(half, path, "piece_bpe_32k.model")
    assert {r.doc_id: r.n_tokens for r in other.collect()} != {d: first[d] for d in first if d % 2 == 0}
    # what the cache says is believed
    digest = cached.first().content
    spark.createDataFrame([(digest, "other version", 10 ** 9)], token_counts.CACHE_SCHEMA).write.mode(
        "append").parquet(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == first


# packing

def check_pieces(pieces, texts, slow, limit=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        want = [*plain_ids(slow, texts[d]), 0]
        own.sort(key=lambda p: p.start)
        joined = []
        for p in own:
            assert p.start == len(joined) and p.doc_tokens == len(want) and p.length > 0
            joined += np.frombuffer(p.ids, "<u4").tolist()
        assert joined == want
    used = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        used += at
    return used / (limit * len(by_sequence))


def test_packing_round_trip(docs, texts, slow):
    for parts in (1, 7, 90):
        fill = check_pieces(packing.pack(docs.repartition(parts, "doc_id")).collect(), texts, slow)
        assert fill > 0.985


def test_packing_digest(docs):
    pieces = packing.pack(docs.limit(20)).collect()
    rows = {(r.doc_id, r.start): r.ids_crc32 for r in packing.report(docs.limit(20)).collect()}
    assert rows == {(p.doc, p.start): zlib.crc32(p.ids) for p in pieces}


def test_packing_odd_rows(odd, nothing, slow):
    pieces = packing.pack(odd).collect()
    assert sum(p.length for p in pieces) == sum(len(plain_ids(slow, t)) + 1 for _, t in ROWS)
    assert {p.length for p in pieces if p.doc in (1, 2)} == {1}
    assert packing.report(nothing).count() == 0


def test_open_windows_are_bounded():
    closed = []
    packer = packing.Packer(16, 3, closed.append)
    rng = np.random.default_rng(0)
    for i in range(500):
        packer.place(i, np.arange(rng.integers(1, 40), dtype=np.uint32))
        assert len(packer.open) <= 3
    assert all(w.used <= 16 for w in closed)


# line dedup

def plain_lines(rows):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (d, _), ks in zip(rows, keys):
        for k in ks:
            if len(k) >= 20:
                holders[k].add(d)
    largest = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items()}
    out = []
    for (d, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, ks) if len(holders.get(k, ())) < 3 or largest[k] == d]
        out.append((d, len(lines), len(lines) - len(stay),
                    hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(docs, texts, odd, nothing, spark):
    def rows(df):
        return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)
                       for r in line_dedup.report(df).collect()), key=repr)
    assert rows(docs) == plain_lines(list(texts.items()))
    assert rows(odd) == plain_lines(ROWS)
    assert rows(nothing) == []
    many = [(i, "\n".join(f"line number {j % 97} of a long document" for j in range(i, i + 300)))
            for i in range(40)]
    assert rows(spark.createDataFrame(many, "doc_id long, text string")) == plain_lines(many)


# near duplicates

def plain_components(rows, words, threshold=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in
                   enumerate(zip(rows, sets))), key=repr)


def found_components(df, **how):
    return sorted(((r.doc, r.n_shingles, r.component) for r in
                   near_dup.near_duplicates(df, **how).collect()), key=repr)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, texts, words):
    assert found_components(docs, words=words) == plain_components(list(texts.items()), words)


def family(size, seed=3):
    """Copies of one text with random edits, some of them far from all others."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 500, 150)]
    rows = []
    for i in range(size):
        edits = rng.choice([2, 6, 12, 20])
        words = list(base)
        for p in rng.integers(0, len(words), edits):
            words[p] = f"e{rng.integers(0, 10 ** 6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("region, signed, neighbours, visits", [
    (2048, 8192, 4, 1 << 26), (32, 20, 1, 1 << 26), (2, 3, 2, 1 << 26),
    (2048, 8192, 1, 0), (2, 3, 1, 0), (32, 20, 1, 200)])
def test_crowded_regions_lose_no_link(spark, monkeypatch, region, signed, neighbours, visits):
    """Regions visited as they are, and cut at rare shingles first."""
    monkeypatch.setattr(near_dup, "SIGNED", signed)
    monkeypatch.setattr(near_dup, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(near_dup, "VISITS", visits)
    rows = family(260)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(df, words=2, region=region) == plain_components(rows, 2)


def test_neighbours_in_a_sorted_order():
    """Of every region: pairs with the rows before it, across batches, and the members of those that
    hold more; a region at an edge of the partition is always passed on."""
    rng = np.random.default_rng(1)
    n = 400
    labels = np.sort(rng.integers(0, 60, n))
    number = np.arange(n) * 7
    zeros = np.zeros(n, np.int64)
    table = pa.table({"region": labels, "rest": zeros, "number": number, "n": zeros + 10,
                      "bits": zeros, "more_bits": zeros})
    for size in (1, 2, 3, 50, n):
        got = pa.Table.from_batches(list(near_dup._forest(0.8, 3)(table.to_batches(max_chunksize=size)))).to_pylist()
        pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
        assert pairs == {(number[i - k], number[i]) for i in range(n) for k in (1, 2, 3)
                         if i >= k and labels[i] == labels[i - k]}
        members = {r["a"] for r in got if r["region"] is not None}
        counts = np.bincount(labels)
        edge = (labels == labels[0]) | (np.arange(n) == n - 1)
        assert members == set(number[(counts[labels] > 1) | edge].tolist())
        flagged = {r["a"] for r in got if r["edge"]}
        assert flagged == set(number[edge].tolist())


def hanging(crowd=60, seed=5):
    """A crowd of near copies, and one more text whose only link, just over the threshold, is to a
    member with which it shares a label to depth 3 but none to depth 5."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]

    def edited(words, places):
        words = list(words)
        for p in places:
            words[p] = f"e{rng.integers(0, 10 ** 9)}"
        return words

    def shared(a, b, depth):
        a, b = (np.frombuffer(near_dup.signature(near_dup.shingles(" ".join(x), 2)), "<u2").reshape(
            near_dup.TREES, near_dup.DEPTH)[:, :depth] for x in (a, b))
        return (a == b).all(1).any()

    members = [edited(base, 3 * rng.choice(48, 4, replace=False) + 1) for _ in range(crowd)]
    while True:
        m = members[int(rng.integers(0, crowd))]
        free = [p for p in range(1, 148, 3) if m[p] == base[p]]
        other = edited(m, rng.choice(free, 8, replace=False))
        if shared(m, other, near_dup.START) and not shared(m, other, 5):
            return [(i, " ".join(w)) for i, w in enumerate([*members, other])]


def test_rare_shingles_of_similar_sets_meet(spark):
    """Sets that reach the threshold share a region, also at it; unlike ones that share half do not."""
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 62, 60, dtype=np.uint64)

    def own(n):
        return rng.integers(1 << 62, 1 << 63, n, dtype=np.uint64)

    sets = [np.concatenate([common, own(60)]) for _ in range(120)]
    for i in range(40):  # copies with 80 of 100 shared at least
        gone = rng.choice(len(sets[i]), rng.integers(1, 14), replace=False)
        sets.append(np.concatenate([np.delete(sets[i], gone), own(int(rng.integers(0, 14)))]))
    sets += [common[:1], common[:9], common[:10], common[:12]]
    rows = [(i.to_bytes(2, "big"), np.sort(x).tobytes()) for i, x in enumerate(sets)]
    at = {}
    for r in near_dup._meetings(spark.createDataFrame(rows, "key binary, members binary"), 0.8).collect():
        at.setdefault(int.from_bytes(r.key, "big"), set()).add(r.region)
    found, met = 0, 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            together = bool(at.get(i, set()) & at.get(j, set()))
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                found += 1
                assert together
            met += together
    assert 30 < found <= met < 200


def test_a_single_link_in_a_crowded_region_is_found(spark, monkeypatch):
    rows = hanging()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows, 2)
    assert found_components(df, words=2, region=2) == want
    assert found_components(df, words=2) == want
    for parts in (3, 40):  # regions that lie across the edges of partitions
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert found_components(df, words=2, region=16) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    monkeypatch.setattr(near_dup, "VISITS", 0)
    assert found_components(df, words=2) == want


def test_near_duplicates_odd_rows(odd, nothing, spark):
    assert found_components(odd, words=2) == plain_components(ROWS, 2)
    assert near_dup.report(nothing).count() == 0
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [r for i, r in enumerate(ROWS) if not (r[1] or "").strip() or r not in ROWS[:i]]
    assert got == sorted(want, key=repr)


# benchmark passages

def plain_hits(rows, items, size=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = split.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add(str(item))
    out = []
    for d, t in rows:
        w = split.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_decontamination(spark, sf_dir, docs, texts, odd, nothing):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = plain_hits(list(texts.items()), items)
    assert rows_of(decontaminate.report(docs, bench)) == want
    assert any(r[5] for r in want)
    short = [(1, "W w W"), (2, None), (3, ""), (4, "x"), (5, "Straße"), (5, "x"), (None, "密码")]
    small = spark.createDataFrame(short, "item_id long, text string")
    expected = plain_hits(ROWS, [(i if i is not None else None, t) for i, t in short if i is not None])
    known = small.where("item_id IS NOT NULL")
    assert rows_of(decontaminate.report(odd, known)) == expected
    assert decontaminate.report(nothing, bench).count() == 0
    assert {r[2] for r in rows_of(decontaminate.report(odd, small.where("false")))} == {0}


def test_decontamination_in_parts_and_spans(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = decontaminate.find(docs, bench, keep=["doc_id", "text"])
    parts = decontaminate.find(docs, bench, keep=["doc_id", "text"], automaton_chars=20_000)

    def plain(df):
        return sorted((r.original.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.hits))
                      for r in df.collect())
    assert plain(whole) == plain(parts) and any(r[2] for r in plain(whole))
    for r in whole.where("n_hit > 0").collect():
        for h in r.hits:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                               r.original.text[h.start:h.end].translate(LOWER))
            assert len(words) == 10


# secrets

SECRETS = (
    ("assign", r"""((?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def plain_secrets(text):
    out = []
    for n, (kind, p) in enumerate(SECRETS):
        for m in re.finditer(p, text or ""):
            size = {"assign": len(m[2]) if kind == "assign" else 0, "access": len(m[0]) - 14,
                    "hex": len(m[0]) - 18}[kind]
            if size >= 6:
                out.append((m.start(), n, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


AWKWARD = ["password=token = abcdefgh", "secret=token=abc", "TOKEN: 'abc123'x", "api_key==abcde",
           "AKIAAKIA" + "A" * 20, "akia" + "f" * 30, "é😀token=abcdef 😀" + "0" * 24, "token=abcdef",
           "a" * 23 + "g" + "a" * 24, "passwd\n=abcdefgh", "token=" * 50, "ſecret=abcdefgh"]


def test_secret_spans(spark, docs, texts, odd, nothing):
    rows = [*texts.items(), *enumerate(AWKWARD, 10 ** 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.report(df).collect()}
    for d, t in rows:
        want = plain_secrets(t)
        assert got[d].spans == ",".join(want), t[:80]
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[d].n_assign == sum(w.startswith("assign") for w in want)
    assert secret_scan.report(odd).count() == len(ROWS)
    assert secret_scan.report(nothing).count() == 0


def test_texts_of_many_hits(spark):
    """Thousands of matches in one text: places stay right, and work grows with their number."""
    import time

    def text(n):
        return " ".join(f"token=abcdef{i}" if i % 2 else "é" + "0" * 24 for i in range(n))

    seconds = {}
    for n in (8_000, 16_000):
        df = stage(spark.createDataFrame([(1, text(n))], "doc_id long, text string"))
        start = time.time()
        row, = secret_scan.report(df).collect()
        seconds[n] = time.time() - start
        want = plain_secrets(text(n))
        assert len(want) == n and row.spans == ",".join(want)
    assert seconds[16_000] < 2 * seconds[8_000] + 2
    bench = spark.createDataFrame([(i, f"word{i} " + "a b c d e f g h i") for i in range(50)], "item_id long, text string")
    long = [(1, " ".join(f"word{i % 60} a b c d e f g h i" for i in range(6_000)))]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    assert rows_of(decontaminate.report(docs, bench)) == plain_hits(long, [(r.item_id, r.text) for r in bench.collect()])


def test_windows_that_many_items_share(spark):
    """A third of the items begin alike: their windows share one set of items."""
    items = [(i, "please answer the following question in one word only now " + (f"subject{i} follows here" if i % 3 else ""))
             for i in range(90)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[0][1]), (2, items[1][1]), (3, "nothing of the kind"), (4, items[0][1]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(decontaminate.report(docs, bench)) == plain_hits(rows, items)
    named, sets = decontaminate.item_sets(decontaminate.windows(bench, 10, "item_id", "text"))
    assert sets.count() < 90 + 3 * 60 and named.select("set").distinct().count() <= 61


def test_ledger_scans_only_unseen_blobs_and_rules(spark):
    path = scratch_path(spark, "ledger")
    first = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("a", "clean")],
                                  "path string, text string")
    got = secret_scan.scan(first, path, "path").collect()
    assert sorted((r.path, len(r.spans)) for r in got) == [("a", 0), ("a", 1), ("b", 1)]
    assert spark.read.parquet(path).count() == 2 * len(secret_scan.RULES)
    more = first.unionByName(spark.createDataFrame([("c", "token=abcdef"), ("c", "AKIA" + "B" * 16)],
                                                   first.schema))
    got = secret_scan.scan(more, path, "path").collect()
    assert sorted((r.path, len(r.spans)) for r in got) == [("a", 0), ("a", 1), ("b", 1), ("c", 1), ("c", 1)]
    assert spark.read.parquet(path).count() == 3 * len(secret_scan.RULES)
    newer = {"assign": "2", "access": "1", "hex": "1"}
    assert secret_scan.scan(more, path, "path", rule_versions=newer).count() == 5
    ledger = spark.read.parquet(path)
    assert ledger.where("version = '2'").count() == 3 and ledger.count() == 12


def test_native_operators_have_no_python(spark, docs):
    for df in (line_dedup.report(docs), secret_scan.report(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# language

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lang_id.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_spans_and_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.train(docs, ~lang_id.held_out())
    clean = {r.lang: r.text for r in docs.where("n_chars BETWEEN 1500 AND 3000 AND text NOT RLIKE '[|&#]'")
             .orderBy("doc_id").collect()}
    text = clean["de"] + "\n12, 3.\n" + clean["fr"]
    _, _, spans = model.label(text)
    assert [s[2] for s in spans] == ["de", "fr"] and abs(spans[1][0] - len(clean["de"])) < 40
    assert model.label("12 34 !?") == ("und", 0.0, []) and model.label(None)[0] == "und"
    rows = lang_id.identify(odd, model).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 9)} == {"und"}
    assert lang_id.identify(nothing, model).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lang_id.report(unlabelled).collect()} == {"und"}


def test_letters_of_any_plane_and_doubt(spark):
    """Late letters are letters; a script that no training text used gives a low score."""
    rows = [(i, lang, text) for i, (lang, text) in enumerate(
        [("de", "der die das und nicht ein haus am see"), ("en", "the house by the lake and not a tree")] * 20)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    for text in ("\U00032050\U00032051", "\U00020000 \U00031360", "密码 密码"):
        lang, score, _ = model.label(text)
        assert lang in ("de", "en") and score < 0.5
    assert 1 >= model.label("das haus und der see")[1] > 0.999 > model.label("am a")[1]
    mixed = model.label("das haus und der see am haus 密码密码密码密码密码密码密码密码密码密码")
    assert mixed[0] == "de" and mixed[1] < 0.6


def plain_lang(model, text):
    """Language and score of a text, letter by letter and by a plain walk over all paths."""
    def script(c):
        names = [n for a, n in lang_id.RANGES if a <= ord(c)] if ord(c) < 0x40000 else ["other"]
        return lang_id.SCRIPTS.index(names[-1])

    def low(c):
        return ord(c.lower()) if len(c.lower()) == 1 else ord(c)

    def bucket(a, b, c):
        m = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % 2 ** 64
        return ((m ^ m >> 29) * 0xBF58476D1CE4E5B9) % 2 ** 64 >> 48

    words, at = [], 0
    text = text or ""
    while at < len(text):
        if not text[at].isalpha():
            at += 1
            continue
        end = at
        while end < len(text) and text[end].isalpha():
            end += 1
        words.append((at, text[at:end]))
        at = end
    if not words or not model.langs:
        return "und", 0.0
    n, scores, known = len(model.langs), [], []
    for _, word in words:
        around = [0, 0, *map(low, word), 0]
        own = sum(model.table[bucket(*around[i:i + 3])].astype(float) for i in range(len(word) + 1))
        k = script(word[0])
        known.append(model.known[k] > 0)
        scores.append((own if known[-1] else 0 * own) + model.barred[k])
    value, back = list(scores[0]), []
    for row in scores[1:]:
        moves = [max((value[j] - lang_id.PENALTY * (j != i), j == i, -j) for j in range(n)) for i in range(n)]
        back.append([-j for _, _, j in moves])
        value = [m[0] + s for m, s in zip(moves, row)]
    path = [max(range(n), key=lambda i: (value[i], -i))]
    for step in reversed(back):
        path.append(step[path[-1]])
    path.reverse()
    letters = [sum(len(w) for (_, w), p in zip(words, path) if p == i) for i in range(n)]
    best = max(range(n), key=lambda i: (letters[i], -i))
    sure = sum(len(w) for (_, w), p, k in zip(words, path, known) if p == best and k) / sum(letters)
    total = sum(s for s, p in zip(scores, path) if p == best)
    return model.langs[best], sure / sum(np.exp(np.minimum(total - total[best], 700)))


def test_language_against_a_plain_version(docs, texts):
    model = lang_id.train(docs, ~lang_id.held_out())
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.report(docs).collect()}
    for d, t in texts.items():
        if t is None or len(t) < 8_000:
            lang, score = plain_lang(model, t)
            assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-3), d


def test_constant_path_rule_agrees_with_the_walk(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(300):
        scores = rng.normal(0, 4, (rng.integers(1, 40), 3))
        if rng.random() < 0.5:
            scores[: len(scores) // 2, 0] += 3
        n, value, back = 3, scores[0].copy(), []
        for row in scores[1:]:
            moves = value[:, None] - lang_id.PENALTY * (1 - np.eye(n))
            back.append(moves.argmax(0))
            value = moves.max(0) + row
        path = lang_id.best_path(scores)
        total = scores[np.arange(len(scores)), path].sum() - lang_id.PENALTY * (np.diff(path) != 0).sum()
        assert total == pytest.approx(value.max())


# quality

def test_quality_on_held_out_documents(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    found = quality.report(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(found) > 500
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_lines_of_a_mixed_document(spark):
    """Good lines before bad ones: their marginals differ, and the chain has learnt to change."""
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    model = quality.train(docs, labels, ~quality.held_out(), max_train=1500)
    lang = F.col("lang") == "en"
    by_label = {q: [r.text for r in docs.where(lang & F.col("n_chars").between(600, 3000)).join(
        labels.where(quality.held_out() & (F.col("quality") == q)), "doc_id").orderBy("doc_id").limit(12).collect()]
        for q in (0, 1)}
    good, bad = by_label[1], by_label[0]
    assert len(good) > 5 and len(bad) > 5
    apart = []
    for a, b in zip(good, bad):
        features, _ = quality.line_features(a + "\n" + b)
        p, n = model.line_marginals(features), len(a.split("\n"))
        apart.append((p[:n].mean(), p[n:].mean()))
    first, second = np.mean(apart, axis=0)
    assert first > 0.7 and second < 0.4 and np.mean([x > y for x, y in apart]) > 0.9


def test_quality_training_is_bounded(spark):
    """Texts of very many short lines are trained on in windows; the driver holds no text."""
    texts = [(i, ("good words in a row here\n" if i % 2 else "!! ## ??\n") * 30_000) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    sample = quality._sample(docs, labels, F.lit(True), 4, "doc_id", "text", "quality")
    assert sample.count() == 4
    rows = sample.select("place", "label", "body").mapInArrow(
        quality._training_lines, "place long, label int, features binary, lengths binary").collect()
    assert {len(r.lengths) for r in rows} == {8 * quality.TRAIN_LINES}
    model = quality.train(docs, labels, F.lit(True))
    assert model.score(texts[1][1]) > 0.7 > 0.5 > model.score(texts[0][1])


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.report(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.report(nothing, labels).count() == 0
    assert {r.score for r in quality.report(odd, labels.where("false")).collect()} == {0.5}


def plain_quality(model, text):
    """Score of a text: features character by character, marginals by sums over both states."""
    lines = (text or "").split("\n")

    def own(line):
        kinds = [quality.CLASSES[quality.CLASS_OF[min(ord(c), 0x250)]] for c in line]
        words, n = line.split(), max(len(line), 1)
        w = max(len(words), 1)
        hard = {"sentence", "quote", "symbol"}
        twice = sum(a == b and k in hard for a, b, k in zip(line, line[1:], kinds[1:]))
        return [*[kinds.count(c) / n for c in quality.CLASSES], np.log1p(len(line)) / 8, np.log1p(len(words)) / 6,
                len(set(words)) / w, sum(len(x) < 4 for x in words) / w, min(len(line) / w, 40) / 40, twice / n,
                kinds.count("symbol") / w, float(not line), sum(a == b for a, b in zip(words, words[1:])) / w]

    each, none = [own(x) for x in lines], [0.0] * quality.N_OWN
    rows = np.array([[1.0, *e, *(each[i - 1] if i else none), *(each[i + 1] if i + 1 < len(each) else none)]
                     for i, e in enumerate(each)])
    scores = rows @ model.weights
    forward = [scores[0] + model.first]
    for s in scores[1:]:
        forward.append(s + np.logaddexp(*(forward[-1][:, None] + model.moves)))
    backward = [np.zeros(2)]
    for s in scores[:0:-1]:
        backward.append(np.logaddexp(*(model.moves + s + backward[-1]).T))
    odds = [f + b for f, b in zip(forward, reversed(backward))]
    good = [1 / (1 + np.exp(o[0] - o[1])) for o in odds]
    sizes = [len(x) + 1 for x in lines]
    share = sum(g * n for g, n in zip(good, sizes)) / sum(sizes)
    slope, offset = model.curve
    return 1 / (1 + np.exp(-(slope * share + offset)))


def test_quality_against_a_plain_version(spark, sf_dir, docs, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~quality.held_out())
    got = {r.doc_id: r.score for r in quality.report(docs, labels).collect()}
    for d, t in texts.items():
        assert got[d] == pytest.approx(plain_quality(model, t), abs=1e-6)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        weights, first, moves = rng.normal(0, 1, (quality.N_FEATURES, 2)), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
        features = rng.normal(0, 0.3, (n, quality.N_FEATURES))
        model = quality.Model(weights, first, moves, (1.0, 0.0))
        total, good = 0.0, np.zeros(n)
        for code in range(2 ** n):
            states = [(code >> i) & 1 for i in range(n)]
            s = first[states[0]] + sum((features[i] @ weights)[states[i]] for i in range(n))
            s += sum(moves[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(s)
            good += np.exp(s) * np.array(states)
        assert model.line_marginals(features) == pytest.approx(good / total)
