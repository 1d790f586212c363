"""Importance resampling, hard negatives and duplicate vectors against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from vecmill.llm import hard_negatives as hn
from vecmill.llm import queries as Q
from vecmill.llm import resampling as rs
from vecmill.llm import vector_dedup as vd

# Resampling ------------------------------------------------------------------------

TEXTS = ["", None, "...", "One two THREE", "ünïcode Ünïcode 日本語 x1", "a " * 3000, "nul\x00byte DEL\x7fend", "same words here", "same words here"]


def brute_resampling(rows, target, how):
    low = str.maketrans(rs.UPPER, rs.LOWER)

    def features(text):
        w = re.findall(rs.WORD, (text or "").translate(low))
        return [" ".join(w[i : i + n]) for n in range(1, how.longest + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % how.buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[0]), Counter(bucket(f) for x in target for f in features(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + how.buckets) / ((s[b] + 1) * (T + how.buckets)))) for b in range(how.buckets)]
    out, able = [], []
    for i, text in rows:
        f, n = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if score is not None and n >= how.least_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(able[: len(able) * how.percent // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    rows += [(None, "a b c " * 20), (150, rows[60][1]), (150, rows[60][1]), (151, "x y " * 15)]
    target = ["w1 w2 w3 w4", "W5", None, ""]
    how = rs.Resampling(longest=longest, percent=23)
    docs = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "doc_id long, text string, rank int, score double, buckets_of_text string")
    got = rs.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), how)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str) == brute_resampling(rows, target, how)
    empty = spark.createDataFrame([], docs.schema)
    assert rs.resampled(empty, empty).count() == 0
    alone = rs.resampled(docs, empty, how)
    assert alone.where("rank is not null").count() == sum(1 for r in brute_resampling(rows, [], how) if r[4])


def test_scoring_neither_explodes_nor_shuffles(spark):
    how = rs.Resampling(buckets=50)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = rs.scored(docs, list(range(50)), how)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Python|Arrow", plan)


# Hard negatives --------------------------------------------------------------------


def brute_negatives(rows, how):
    rows = [(i, l, [math.floor(how.scale * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-hn.NO_END, min(hn.NO_END, sum(x * y for x, y in zip(a, b))))  # noqa: E731, B905
    out = []
    for i, l, v in rows:
        if i % how.anchor_every:
            continue
        scores = [(-dot(v, w), j, m) for j, m, w in rows]
        for p, j, _ in sorted(x for x in scores if x[2] == l and x[1] != i)[: how.positives]:
            window = sorted(x for x in scores if x[2] != l and how.percent * -p <= 100 * -x[0] <= 100 * -p)[: how.negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(seed, n, dim=12, spread=0.4):
    """Copies, near copies and strangers; labels in no order."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 8), dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * spread
    x[n // 3 : n // 2] = x[0]  # a third of all rows are copies or nearly so
    x[n // 2 : n // 2 + n // 6] = x[0] + rng.normal(size=(n // 6, dim)) * 0.05
    return np.float32(x).astype(float).tolist(), rng.integers(0, 4, n).tolist()


ODD = [(9001, None, 1), (9002, [float("nan"), 1.0], 1), (9003, [float("inf"), 1.0], 2), (9004, [None, 2.0], 2), (9005, [0.0, 0.0], 3), (9006, [], 1), (9007, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (9100, [0.5, 0.25, 0.125], 1)]
SCHEMA = "vec_id long, embedding array<double>, label int, query int, node string, vec string, tree string, w string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "v", "t", "w") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_negatives_equal_brute_force(spark, seed):
    x, labels = vectors(seed, 300)
    rows = list(zip(range(300), x, labels, strict=True)) + ODD + [(7, x[7], 1), (7, x[7], 2)]
    how = hn.Mining(anchor_every=10, leaf=8, least_rows=40)
    got = hn.hard_negatives(frame(spark, rows), how).collect()
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == brute_negatives(rows, how)


def test_negatives_of_large_components_and_of_nothing(spark):
    rows = [(i, [float(3**i) * 1e3, -float(i), 1e-3 * i], i % 2) for i in range(20)]
    how = hn.Mining(anchor_every=5, percent=1, leaf=2, least_rows=5)
    want = brute_negatives(rows, how)
    got = hn.hard_negatives(frame(spark, rows), how).collect()
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == want and len(want) > 20
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    assert hn.hard_negatives(frame(spark, ODD[:5])).count() == 0
    assert [tuple(r)[:4] for r in hn.hard_negatives(frame(spark, ODD)).collect()] == [r[:4] for r in brute_negatives(ODD, hn.Mining())] == [(9100, 9006, 1, 9005)]


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(200, 6)) + 9 * rng.normal(size=6) for _ in range(8)])
    labels = np.repeat(np.arange(8), 200)
    tree, q = hn.BallTree(points, labels, 50), rng.normal(size=(30, 6))
    norm = np.sqrt((q**2).sum(1))
    for level, cut in enumerate(tree.ends):
        least, most = tree.bounds(level, q, norm)
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            s = q @ points[tree.order[lo:hi]].T
            assert (s.min(1) >= least[:, k]).all() and (s.max(1) <= most[:, k]).all()
    least, most = tree.bounds(tree.depth, q, norm)
    best = np.sort(q @ points.T, axis=1)[:, -5]
    assert (most < best[:, None]).mean() > 0.3  # leaves that the k-th score leaves out


# Duplicate vectors -----------------------------------------------------------------


def brute_links(rows, least):
    wide = max((len(v) for _, v, _ in rows if v), default=1)
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    x = np.array([[*(v if good else []), *[0.0] * (wide - (len(v) if good else 0))] for (_, v, _), good in zip(rows, ok, strict=True)])
    norm = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / np.where(norm[:, None] * norm == 0, np.inf, norm[:, None] * norm) >= least
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    ids = [r[0] for r in rows]
    group = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            group[r] = min(ids[i], group.get(r, ids[i]))
    return sorted(((ids[i], int(near[i].sum()), group.get(root[i]), ids[i] is not None and ids[i] == group.get(root[i])) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("seed,tile,box", [(0, 40, 20), (1, 10_000, 60), (2, 7, 1000)])
def test_links_equal_brute_force(spark, seed, tile, box):
    x, labels = vectors(seed, 260, spread=0.25)
    rows = list(zip(range(260), x, labels, strict=True)) + ODD + [(7, x[7], 1), (7, x[9], 2), (9200, [19.0, 6.0, 1.0, 1.0, 1.0], 1), (9201, [1.0], 1)]
    how = vd.Pigeonhole(tile_rows=tile, box_rows=box, pairs_at_once=50)
    got = vd.near_duplicate_vectors(frame(spark, rows), how).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute_links(rows, 0.95)
    distinct = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {y[0] for y in rows[:i]}]
    got = vd.near_duplicate_vectors(frame(spark, distinct), how).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute_links(distinct, 0.95)


def test_links_of_nothing(spark):
    assert vd.near_duplicate_vectors(frame(spark, [])).count() == 0
    got = vd.near_duplicate_vectors(frame(spark, ODD[:4])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, 0, i, True) for i in (9001, 9002, 9003, 9004)]


def test_rotation_keeps_lengths_and_bits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 37))
    r = vd.rotated(x)
    assert r.shape == (50, 64) and np.allclose((r * r).sum(1), 1)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    assert np.allclose(r @ r.T, unit @ unit.T)
    assert (vd.rotated(x[13:14]) == r[13:14]).all()


@pytest.mark.parametrize("name", ["op11_resampling", "op12_hard_negatives", "op13_vector_duplicates"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    cur = con.execute(Q.oracle_sql()[name])
    order = [c[0] for c in cur.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*order).collect()), key=str) == sorted(map(tuple, cur.fetchall()), key=str)
