"""Hard negatives by branch and bound in ball trees, one tree for each share of the rows.

Rows are dealt to trees by a hash of their id, so no label, source or group of copies
makes a tree larger than another, and every query meets every tree as one row that
streams past it.  A ball with centre ``c`` and radius ``r`` bounds a query's inner products
by ``q.c - |q| r`` and ``q.c + |q| r``.  A node is left out when these bounds lie outside the
query's score window, when all its rows have a label that is not asked for, or when the
upper bound lies strictly beneath the query's current k-th score.  Trees return their own
best k rows; a window over a query's few rows from all trees gives the final ones.

Components are scaled and rounded down to integers, so scores are exact: beyond the range
in which doubles hold them they are computed with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

EXACT = float(1 << 53)
NO_END = 1 << 62  # scores beyond it, in either direction, count as it; a window's open end


@dataclass(frozen=True)
class Mining:
    anchor_every: int = 100  # anchors are the rows whose id is divisible by it
    positives: int = 5  # for each anchor
    negatives: int = 5  # for each anchor and positive
    percent: int = 80  # of the positive's score is the least score of a negative
    scale: int = 256  # of components, which are then rounded down
    leaf: int = 256  # rows to a leaf
    least_rows: int = 1024  # rows to a tree, and
    most_rows: int = 250_000  # bound of what a task holds


def usable(vec: Column) -> Column:
    """Vectors that are not null and have only finite components."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class BallTree:
    """A complete binary tree over rows, halved along the axis of largest spread."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        order, ends = np.arange(n), [np.array([0, n])]
        for _ in range(self.depth):
            cut = [0]
            for lo, hi in zip(ends[-1][:-1], ends[-1][1:], strict=True):
                own = points[order[lo:hi]]
                mid = (hi - lo) // 2
                if hi - lo > 1:
                    axis = int(np.argmax(own.max(0) - own.min(0)))
                    order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
                cut += [lo + mid, hi]
            ends.append(np.array(cut))
        self.order, self.ends, self.levels = order, ends, []
        for cut in ends:
            centre, radius, first, last = [], [], [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own, kind = points[order[lo:hi]], labels[order[lo:hi]]
                c = own.mean(0) if hi > lo else np.zeros(points.shape[1])
                centre.append(c)
                radius.append(np.sqrt(((own - c) ** 2).sum(1).max()) if hi > lo else -np.inf)
                first.append(kind.min() if hi > lo else 0)
                last.append(kind.max() if hi > lo else 0)
            self.levels.append((np.array(centre), np.array(radius), np.array(first), np.array(last)))

    def bounds(self, level: int, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with each node's rows; the slack
        covers rounding."""
        centre, radius, _, _ = self.levels[level]
        mid, wide = q @ centre.T, norm[:, None] * np.maximum(radius, 0)[None]
        wide = wide + 1e-9 * (wide + np.abs(mid) + norm[:, None] * np.sqrt((centre**2).sum(1))[None]) + 1e-6
        empty = np.isneginf(radius)
        held = lambda x: np.clip(x, -float(NO_END), float(NO_END))
        return np.where(empty, np.inf, held(mid - wide)), np.where(empty, -np.inf, held(mid + wide))


def search(tree: BallTree, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_id: np.ndarray, q_label: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's ``k`` best rows with a score from ``lo`` to ``hi``
    and its own label (``same``, without its own id) or another one.  Ties by id."""
    m, norm = len(q), np.sqrt((q**2).sum(1))
    exact = m == 0 or len(points) == 0 or np.abs(q).max() * np.abs(points).max() * points.shape[1] < EXACT
    low, high = (lo, hi) if exact else (lo.astype(object), hi.astype(object))
    active = np.ones((m, 1), bool)
    for level in range(tree.depth + 1):
        if level:
            active = np.repeat(active, 2, axis=1)
        least, most = tree.bounds(level, q, norm)
        _, _, first, last = tree.levels[level]
        active &= (most >= lo[:, None]) & (least <= hi[:, None])
        if same:
            active &= (first[None] <= q_label[:, None]) & (q_label[:, None] <= last[None])
        else:
            active &= ~((first == last)[None] & (first[None] == q_label[:, None]))
    kth = np.full(m, -np.inf)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if exact else object))
    cut = tree.ends[-1]

    def visit(leaf: int, who: np.ndarray) -> None:
        nonlocal best
        rows = tree.order[cut[leaf] : cut[leaf + 1]]
        if exact:
            s = q[who] @ points[rows].T
        else:
            whole = [[int(x) for x in y] for y in points[rows]]
            s = np.array([[max(-NO_END, min(NO_END, sum(int(a) * b for a, b in zip(x, y, strict=True)))) for y in whole] for x in q[who]], object)
        ok = (s >= low[who][:, None]) & (s <= high[who][:, None]) & ((labels[rows][None] == q_label[who][:, None]) == same) & (s >= kth[who][:, None])
        ok = ok.astype(bool)
        if same:
            ok &= ids[rows][None] != q_id[who][:, None]
        i, j = np.nonzero(ok)
        if not len(i):
            return
        qi = np.concatenate((best[0], who[i]))
        di, sc = np.concatenate((best[1], ids[rows[j]])), np.concatenate((best[2], s[i, j].astype(np.int64) if exact else s[i, j]))
        order = np.lexsort((di, -sc, qi)) if exact else np.array(sorted(range(len(qi)), key=lambda x: (qi[x], -sc[x], di[x])))
        qi, di, sc = qi[order], di[order], sc[order]
        new = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1])))
        place = np.arange(len(qi)) - np.repeat(new, np.diff(np.append(new, len(qi))))
        keep = place < k
        full = place == k - 1
        kth[qi[full]] = sc[full].astype(float)
        if not exact:
            kth[qi[full]] -= np.abs(kth[qi[full]]) * 1e-12  # rounded downwards
        best = (qi[keep], di[keep], sc[keep])

    least, most = tree.bounds(tree.depth, q, norm)
    most = np.where(active, most, -np.inf)
    first_leaf = most.argmax(1) if m else np.zeros(0, np.int64)
    for leaf in np.unique(first_leaf):  # each query's most promising leaf gives a first k-th score
        who = np.flatnonzero((first_leaf == leaf) & active[:, leaf])
        visit(leaf, who)
        active[who, leaf] = False
    for leaf in np.argsort(-most.max(0)) if m else ():
        who = np.flatnonzero(active[:, leaf] & (most[:, leaf] >= kth))
        if len(who):
            visit(leaf, who)
    return best


def _stacked(column: pa.Array) -> np.ndarray:
    width = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (width == width[:1]).all():
        return flat.reshape(len(column), int(width[0]) if len(width) else 0)
    out = np.zeros((len(column), int(width.max())))  # a shorter vector ends in zeros
    out[np.arange(out.shape[1])[None] < width[:, None]] = flat
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.hstack((x, np.zeros((len(x), width - x.shape[1]))))


def best_in_trees(rows: DataFrame, queries: DataFrame, same: bool, k: int, how: Mining, batch_queries: int = 1024) -> DataFrame:
    """``query, id, score``: at least the ``k`` best rows of each query, those of every tree.

    ``rows`` has ``id, label, vec`` (scaled components), ``queries`` has ``query, id, label,
    vec, lo, hi``.  A task holds one tree and one batch of queries at a time."""
    spark = rows.sparkSession
    n, parts = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = max(-(-n // how.most_rows), min(parts, -(-n // how.least_rows)), 1)
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(trees)).cast("int").alias("tree"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("query"), "id", "label", "vec", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).alias("role"), "query", "id", "label", "vec", "lo", "hi")
    dealt = own.unionByName(asked).repartition(trees, "tree").sortWithinPartitions("tree", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, held, waiting = None, None, [], []
        points = ids = labels = None

        def answers(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            while waiting and (final or sum(b.num_rows for b in waiting) >= batch_queries):
                t = pa.Table.from_batches(waiting).combine_chunks()
                part, rest = t.slice(0, batch_queries), t.slice(batch_queries)
                waiting = rest.to_batches() if rest.num_rows else []
                if tree is None:
                    continue
                col = lambda name: part[name].combine_chunks().to_numpy()  # noqa: E731, B023
                q = _stacked(part["vec"].combine_chunks())
                width = max(q.shape[1], points.shape[1])
                if points.shape[1] < width:
                    q = q[:, : points.shape[1]]  # what exceeds all rows meets zeros
                qi, di, sc = search(tree, points, ids, labels, _widened(q, points.shape[1]), col("id"), col("label"), col("lo"), col("hi"), same, k)
                yield pa.RecordBatch.from_arrays([pa.array(col("query")[qi]), pa.array(di), pa.array(sc.astype(np.int64))], names=["query", "id", "score"])

        for batch in batches:
            which, role = batch["tree"].to_numpy(), batch["role"].to_numpy()
            start = 0
            while start < batch.num_rows:
                end = start + int(np.argmax(np.append((which[start:] != which[start]) | (role[start:] != role[start]), True)))
                piece = batch.slice(start, end - start)
                if which[start] != now:
                    yield from answers(True)
                    tree, now, held = None, int(which[start]), []
                if role[start] == 0:
                    held.append(piece)
                else:
                    if held:
                        t = pa.Table.from_batches(held).combine_chunks()
                        held = []
                        points, ids, labels = _stacked(t["vec"].combine_chunks()), t["id"].combine_chunks().to_numpy(), t["label"].combine_chunks().to_numpy()
                        tree = BallTree(points, labels, how.leaf)
                    waiting.append(piece)
                    yield from answers(False)
                start = end
        yield from answers(True)

    return dealt.mapInArrow(run, "query long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ``rank`` from 1: a query has at most ``k`` rows a tree."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, how: Mining = Mining(), vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best other rows of its label; a positive's negatives are
    the best rows of other labels that score at most as much as the positive and at least
    ``percent`` per cent of it.  Rows with a null id, label or vector, or with a null or
    non-finite component, take no part; nor does an anchor's own id as its positive.  Rows
    that repeat an id count each.  Vectors of different lengths meet as if they ended in
    zeros.  Scores beyond 2**62 in size count as that.  An empty table gives no rows.
    Further columns are ignored, whatever their names.  Labels are integers."""
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    rows = saved(own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: _floor(x * float(how.scale)))))
    anchors = saved(rows.where(F.col("id") % how.anchor_every == 0).withColumn("query", F.monotonically_increasing_id()))
    open_ = anchors.withColumns({"lo": F.lit(-NO_END), "hi": F.lit(NO_END)})
    near = saved(_first(best_in_trees(rows, open_, True, how.positives, how), how.positives).select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    # Whole numbers n with percent * positive <= 100 * n <= 100 * positive.
    ends = near.withColumns({"query": F.col("anchor") * how.positives + F.col("place") - 1, "lo": -F.floor(-F.col("positive_score").cast("decimal(30,0)") * how.percent / 100).cast("long"), "hi": F.col("positive_score")})
    asked = saved(ends.join(anchors.select(F.col("query").alias("anchor"), F.col("id"), "label", "vec"), "anchor"))
    found = _first(best_in_trees(rows, asked, False, how.negatives, how), how.negatives)
    told = asked.select("query", F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return found.join(told, "query").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor(x: Column) -> Column:
    """Rounded down, as a double of any size."""
    whole = F.rint(x)
    return F.when(whole > x, whole - 1).otherwise(whole)


def hard_negatives_sql(how: Mining = Mining()) -> str:
    return f"""WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor({how.scale} * x)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM usable a, usable b WHERE a.vec_id % {how.anchor_every} = 0),
positives AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM pairs WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {how.positives})
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> p.anchor_label AND {how.percent} * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= {how.negatives}"""
