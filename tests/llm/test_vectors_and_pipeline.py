import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.llm import graph, vectors

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, home string, x string"


def plain(rows, threshold=0.93):
    """(n_links, component) by id, all pairs compared."""
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows
              if i is not None and lab is not None and v and all(e is not None for e in v)
              and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a in range(len(usable)):
        for b in range(a):
            (i, x, la), (j, y, lb) = usable[a], usable[b]
            if i != j and la == lb and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), None if i is None else min(seen))
    return out


def found(df, **how):
    return {r.id: (r.n_links, r.component) for r in vectors.near_duplicates(df, **how).collect()}


def made(spark, rows):
    return spark.createDataFrame([(i, v, lab, "h", "x") for i, v, lab in rows], SCHEMA)


def clustered(n, dims, groups, noise, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, dims))
    return [(i, (centres[g := rng.integers(0, groups)] + rng.normal(0, noise, dims)).tolist(), int(g % 3))
            for i in range(n)]


@pytest.mark.parametrize("noise", [0.05, 0.2, 0.27])
def test_links_against_all_pairs(spark, noise):
    rows = clustered(900, 32, 12, noise)
    want, got = plain(rows), found(made(spark, rows))
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.99 * total
    assert all(got[i][0] <= want[i][0] for i in want)
    if noise < 0.1:
        assert got == want


def test_cells_and_groups_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 50)
    rows = clustered(600, 16, 1, 0.02)
    assert found(made(spark, rows)) == plain(rows)
    rows = clustered(600, 16, 9, 0.02)
    assert found(made(spark, rows), cell=10) == plain(rows)


def planted(n, dims, rank, cosines, seed=1):
    """Unit vectors in a subspace of ``rank`` dimensions, a third of them displaced from another one
    within it to one of the given cosines."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(0, 1, (dims, rank)))[0].T
    x = rng.normal(0, 1, (n, rank))
    x /= np.sqrt((x * x).sum(1))[:, None]
    far = n - n // 3
    for i in range(far, n):
        start = x[rng.integers(0, far)]
        aside = rng.normal(0, 1, rank)
        aside -= (aside @ start) * start
        c = float(rng.choice(cosines))
        x[i] = c * start + np.sqrt(1 - c * c) * aside / np.sqrt(aside @ aside)
    return x @ basis


def recall(got, want):
    """Share of the links that are found; none may be found that is not there."""
    assert all(got[i][0] <= want[i][0] for i in want)
    return sum(n for n, _ in got.values()) / sum(n for n, _ in want.values())


def linked(x, threshold=0.93):
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return {i: (int(r.sum()), None) for i, r in enumerate(near)}


@pytest.mark.parametrize("dims, rank", [(64, 64), (64, 8), (64, 4), (33, 33)])
@pytest.mark.parametrize("codes", [16, 64])
def test_recall_of_large_grids(spark, dims, rank, codes):
    """Codebooks of 16 and 64 a half, isotropic and low-rank data, links near the threshold."""
    n = 3000
    x = planted(n, dims, rank, [0.931, 0.94, 0.96, 0.99])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>, label int")
    got = found(df, cell=n / codes ** 2)
    assert recall(got, linked(x)) >= 0.99


def test_each_length_has_a_grid_of_its_own(spark):
    """One row of 1,024 numbers and many of 16 leave the links of the others as they are."""
    short, usual, one = planted(400, 16, 16, [0.94]), planted(1200, 64, 12, [0.935, 0.97]), planted(4, 1024, 4, [0.99])
    rows, want, at = [], {}, 0
    for x in (short, usual, one):
        rows += [(at + i, v.tolist(), 1) for i, v in enumerate(x)]
        want.update({at + i: n for i, n in linked(x).items()})
        at += len(x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert recall(found(df, cell=5), want) >= 0.99


def test_walk_is_the_multi_sequence(monkeypatch):
    """Cells come by rising cost, the home first, and all that cost no more than the stop."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, 12))
    x /= np.sqrt((x * x).sum(1))[:, None]
    grid = vectors.Grid(vectors._codebook(x[:, :6], 9), vectors._codebook(x[:, 6:], 7))
    grid.calibrate(x[:250], x[250:] - x[:250], 0.3)
    a, b = grid.costs(x)
    for i, cells in enumerate(grid.walk(x)):
        cost = (a[i][:, None] + b[i][None, :]).ravel()
        along = cost[cells]
        assert cells[0] == grid.codes(x[i:i + 1])[0] and (np.diff(along) >= 0).all()
        assert sorted(cells) == np.flatnonzero(cost <= grid.limit).tolist()


def test_many_copies_are_one_entry(spark):
    """A third of the rows hold one vector: its links are counted without comparing the copies."""
    x = planted(300, 16, 5, [0.95])
    rows = [(i, x[0 if i % 3 == 0 else i % 300].tolist(), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    y = np.array([v for _, v, _ in rows])
    got, want = found(df, cell=20), linked(y)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}


def test_odd_vectors(spark):
    one = [1.0] + [0.5] * 7
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 8, 1),
            (7, [float("nan")] + one[1:], 1), (8, [float("inf")] + one[1:], 1), (9, one[:4], 1),
            (10, [None, *one[1:]], 1), (11, [], 1), (2, one, 1), (None, one, 1), (12, [2 * e for e in one], 1),
            (13, [1e38 * e for e in one], 1), (14, [1e-40 * e for e in one], 1)]
    got = found(made(spark, rows))
    assert got[1] == (4, 1) and got[2] == (4, 1) and got[12] == (4, 1) and got[13] == (4, 1)
    assert got[3] == (0, 3) and got[None] == (0, None)
    for i in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i)
    assert vectors.near_duplicates(made(spark, rows)).count() == len(rows)
    assert vectors.near_duplicates(made(spark, rows[:0])).count() == 0


def test_recall_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.where("label < 3").collect()]
    want = plain(rows)
    got = found(df.where("label < 3"))
    assert got == want


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5000, 5000)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201))
    assert got[1002] == 1000 and got[5000] == 5000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline

@pytest.fixture(scope="module")
def stages(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stage(function(spark, out[-1], root), "test"))
    return out


def test_stages_keep_the_columns_and_decide(spark, stages):
    from tests.llm.test_text_operators import plain_components, plain_hits, plain_lines

    root = "/root/testdata/sf0.01"
    docs, good, lines, first, clean, packed = stages
    for df in (good, lines, first, clean):
        assert df.schema == docs.schema
    texts = [{r.doc_id: r.text for r in df.collect()} for df in stages[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    # clean documents stay, bad ones go
    assert sum(labels[d] for d in labels) * 0.99 <= sum(labels[d] for d in labels if d in texts[1])
    assert sum(1 - labels[d] for d in labels if d in texts[1]) <= 0.1 * sum(1 - q for q in labels.values())
    # every document stays, repeated lines go
    want = {d: (n, gone) for d, n, gone, _ in plain_lines(list(texts[1].items()))}
    assert set(texts[2]) == set(texts[1])
    for d, t in texts[2].items():
        n, gone = want[d]
        assert (len(t.split("\n")) if n > gone else 0) == n - gone
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    # one of each group
    groups = {d: c for d, _, c in plain_components(list(texts[2].items()), 5)}
    assert set(texts[3]) == {d for d, c in groups.items() if d == c}
    # no benchmark passage is left, nothing else goes
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    hit = {r[0] for r in plain_hits(list(texts[3].items()), items) if r[5]}
    assert hit and set(texts[4]) == set(texts[3]) - hit
    assert {r.doc_id for r in packed.collect()} == set(texts[4])


def test_stages_on_awkward_rows(spark):
    root = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{root}/documents.parquet")
    extra = {c: F.lit("x") for c in ("score", "original", "row", "key", "body", "kept", "_label")}
    odd = spark.createDataFrame(
        [(None, "some text without id", None, None, None), (10 ** 6, None, None, None, None),
         (10 ** 6 + 1, "", "en", "s", 0), (10 ** 6 + 2, "short", "en", "s", 5),
         (10 ** 6 + 2, "short", "en", "s", 5)], base.schema)
    for docs in (base.limit(30).unionByName(odd).withColumns(extra), base.limit(0).withColumns(extra)):
        counts = Counter()
        for name, function in corpus_pipeline.STAGES[:-1]:
            got = corpus_pipeline.stage(function(spark, docs, root), "test")
            assert got.columns == docs.columns
            counts[name] = got.count()
            assert counts[name] <= docs.count()
            docs = got
        assert corpus_pipeline.packed(spark, docs, root).count() >= 0
