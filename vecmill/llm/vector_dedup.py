"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one, rotated, and cut into low-dimensional blocks.  A cosine
of at least ``c`` is a squared distance of at most ``2 - 2c``; the blocks' squared
distances add up to it, so if every block has a share of that budget (in proportion to the
block's part of the data's energy), a pair that is near is within the share of at least
one block.  In each block a range join finds the pairs within its share: the block's space
is cut into boxes (medians of a bounded sample), a vector lives in one box and visits
those later boxes that its ball reaches, so a pair meets once in a block.  A pair counts in
the first block whose share it keeps, and is verified on the whole vectors in double
precision, so the union over the blocks is exact and nothing is counted twice.

Pairs never become rows: a task counts each vector's links and returns a forest of each
tile's links.  Equal vectors are one vector with a weight, and crowded boxes are cut into tiles,
pairs of chunks of bounded size, so a large group of copies is the work of many tasks.

The rotation is a signed fast Hadamard transform: only sums and differences, element by
element, so every task gets the same bits for a vector whatever its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hard_negatives import _stacked, usable
from .linking import components, node_ids
from .storage import saved


@dataclass(frozen=True)
class Pigeonhole:
    least_cosine: float = 0.95
    blocks: int = 8
    box_rows: int = 8192  # vectors that live in a box, about
    most_splits: int = 12  # of a block's space: 4096 boxes at most
    tile_rows: int = 16_384  # vectors of each side of a tile, about
    sample_rows: int = 20_000  # for the boxes and the shares; the result does not depend on it
    pairs_at_once: int = 1 << 16  # candidates verified together


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit rows, signs flipped at random, through a Hadamard transform of the next power
    of two."""
    x = x / np.sqrt((x * x).sum(1))[:, None]
    wide = 1 << max(0, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), wide))
    out[:, : x.shape[1]] = x * np.where(np.random.default_rng(11).random(x.shape[1]) < 0.5, -1.0, 1.0)
    h = 1
    while h < wide:
        pair = out.reshape(len(x), wide // (2 * h), 2, h)
        out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(len(x), wide)
        h *= 2
    return out / np.sqrt(wide)


@dataclass(frozen=True)
class Boxes:
    """``share`` of the squared-distance budget of each block, and the boxes' bounds
    (block, box, coordinate)."""

    share: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.share)

    def cut(self, r: np.ndarray) -> np.ndarray:
        return r.reshape(len(r), self.blocks, -1)

    def places(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and codes ``(block * boxes + box) * 2 + visits`` of each rotated row."""
        n, boxes = len(r), self.low.shape[1]
        row, code = [], []
        for b, y in enumerate(self.cut(r).transpose(1, 0, 2)):
            home = np.zeros(n, np.int64)
            near = np.zeros((n, boxes), bool)
            for k in range(boxes):
                home[((y >= self.low[b, k]) & (y < self.high[b, k])).all(1)] = k
                gap = np.maximum(np.maximum(self.low[b, k] - y, y - self.high[b, k]), 0.0)
                near[:, k] = (gap * gap).sum(1) <= self.share[b] + 1e-9
            near &= np.arange(boxes)[None] > home[:, None]
            i, k = np.nonzero(near)
            row += [np.arange(n), i]
            code += [(b * boxes + home) * 2, (b * boxes + k) * 2 + 1]
        row, code = np.concatenate(row), np.concatenate(code)
        order = np.argsort(row, kind="stable")
        return np.searchsorted(row[order], np.arange(n + 1)), code[order]


def fit_boxes(sample: np.ndarray, splits: int, how: Pigeonhole) -> Boxes:
    """Boxes by halving a block's sample along its axis of largest variance."""
    wide = sample.shape[1]
    blocks = min(how.blocks, wide)
    y = sample.reshape(len(sample), blocks, wide // blocks)
    energy = (y * y).mean((0, 2)) + 1e-6 if len(y) else np.ones(blocks)
    budget = 2 - 2 * how.least_cosine + 1e-6  # rounding is left to the verification
    low, high = [], []
    for b in range(blocks):
        parts = [(y[:, b], np.full(wide // blocks, -np.inf), np.full(wide // blocks, np.inf))]
        for _ in range(splits):
            halves = []
            for own, lo, hi in parts:
                axis = int(own.var(0).argmax()) if len(own) else 0
                mid = float(np.median(own[:, axis])) if len(own) else 0.0
                mid = min(max(mid, lo[axis]), hi[axis])
                left, right = hi.copy(), lo.copy()
                left[axis] = right[axis] = mid
                below = own[:, axis] < mid
                halves += [(own[below], lo, left), (own[~below], right, hi)]
            parts = halves
        low.append([p[1] for p in parts])
        high.append([p[2] for p in parts])
    return Boxes(budget * energy / energy.sum(), np.array(low), np.array(high))


def near_pairs(a: np.ndarray, b: np.ndarray, block: int, boxes: Boxes, own: bool, how: Pigeonhole) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of ``a`` and ``b`` (of ``a`` alone if ``own``) that are near and
    keep this block's share but no earlier one's."""
    ra, rb = rotated(a), rotated(b)
    x, y = boxes.cut(ra)[:, block].astype(np.float32), boxes.cut(rb)[:, block].astype(np.float32)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    left, right, limit = [], [], np.float32(boxes.share[block] + 4e-6)
    high = max(1, (1 << 22) // max(len(b), 1))
    for at in range(0, len(a), high):
        i, j = np.nonzero(xx[at : at + high, None] + yy[None] - 2 * (x[at : at + high] @ y.T) <= limit)
        i += at
        if own:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), how.pairs_at_once):
            p, q = i[k : k + how.pairs_at_once], j[k : k + how.pairs_at_once]
            d = boxes.cut(ra[p] - rb[q])
            kept = (d * d).sum(2) <= boxes.share
            first = kept[:, block] & ~kept[:, :block].any(1)
            p, q = p[first], q[first]
            near = (a[p] * b[q]).sum(1) / (na[p] * nb[q]) >= how.least_cosine
            left.append(p[near])
            right.append(q[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` nodes reaches by the edges ``a, b``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _tile_rows(block: int, boxes: Boxes, sides: list[list[pa.RecordBatch]], with_own: bool, how: Pigeonhole) -> Iterator[pa.RecordBatch]:
    """Counts ``a, null, n`` and links ``a, b, null`` of one tile."""
    node, weight, vec = [], [], []
    for held in sides:
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        node.append(t["node"].to_numpy() if held else np.zeros(0, np.int64))
        weight.append(t["w"].to_numpy() if held else np.zeros(0, np.int64))
        vec.append(_stacked(t["vec"].combine_chunks()) if held else None)
    if vec[0] is None or vec[1] is None and not with_own:
        return
    found = [near_pairs(vec[0], vec[0], block, boxes, True, how)] if with_own else []
    split = len(node[0])
    if vec[1] is not None:
        i, j = near_pairs(vec[0], vec[1], block, boxes, False, how)
        found.append((i, j + split))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if not len(a):
        return
    nodes, weights = np.concatenate(node), np.concatenate(weight)
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, a, weights[b])
    np.add.at(n, b, weights[a])
    met, root = np.flatnonzero(n), forest(len(nodes), a, b)
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    none = pa.nulls(len(met), pa.int64()), pa.nulls(len(tied), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((nodes[met], nodes[tied]))), pa.concat_arrays([none[0], pa.array(nodes[root[tied]])]), pa.concat_arrays([pa.array(n[met]), none[1]])], names=["a", "b", "n"])


def near_links(units: DataFrame, how: Pigeonhole) -> tuple[DataFrame, DataFrame]:
    """(``node, n_links``; links ``a, b`` that connect what is linked) of ``node, w, vec``:
    distinct vectors of one length with their weights."""
    spark = units.sparkSession
    n, parts = units.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = min(how.most_splits, max(0, int(np.ceil(np.log2(max(n, 1) / how.box_rows)))))
    part = min(1.0, 1.2 * how.sample_rows / max(n, 1))
    some = units.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(part * (1 << 20))).select("vec").limit(how.sample_rows).collect()  # sample_rows at most
    boxes = fit_boxes(rotated(np.array([r.vec for r in some], np.float64)) if some else np.zeros((0, 1)), splits, how)
    shared, count = spark.sparkContext.broadcast(boxes), boxes.low.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                offsets, code = shared.value.places(rotated(_stacked(piece["vec"])))
                yield pa.RecordBatch.from_arrays([piece["node"], piece["w"], piece["vec"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(code.astype(np.int32)))], names=["node", "w", "vec", "places"])

    placed = saved(units.mapInArrow(place, f"node long, w long, vec {units.schema['vec'].dataType.simpleString()}, places array<int>"))
    # How many live in each box and visit it: one row a box.
    sizes = placed.select(F.explode("places").alias("code")).groupBy(F.expr("shiftright(code, 1)").alias("box")).agg(F.count_if(F.expr("code % 2 = 0")).alias("lives"), F.count_if(F.expr("code % 2 = 1")).alias("visits"))
    chunks = lambda c: F.ceil(F.col(c) / how.tile_rows).cast("int")
    sizes = F.broadcast(saved(sizes.where("lives > 0").select("box", chunks("lives").alias("high"), F.greatest(chunks("visits"), F.lit(1)).alias("wide"))))  # blocks x boxes rows, 32,768 at most
    rows = placed.select("node", "w", "vec", F.explode("places").alias("code")).withColumn("box", F.expr("shiftright(code, 1)")).join(sizes, "box")
    rows = rows.withColumn("c", F.expr("cast(if(code % 2 = 0, pmod(xxhash64(node), high), high + pmod(xxhash64(node), wide)) as int)"))
    # A chunk of those that live in a box is the left side of tiles with every later chunk
    # and every chunk of visitors; with the first of these it also meets itself.
    left = F.expr("if(c < high, transform(sequence(c + 1, high + wide - 1), j -> struct(c as i, j as j, 0 as side)), array())")
    right = F.expr("if(c > 0, transform(sequence(0, least(c, high) - 1), i -> struct(i as i, c as j, 1 as side)), array())")
    rows = rows.select("node", "w", "vec", "box", "high", F.explode(F.concat(left, right)).alias("t")).select("box", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.side").alias("side"), (F.col("t.j") == F.col("high")).alias("own"), "node", "w", "vec")
    dealt = rows.repartition(parts, "box", "i", "j").sortWithinPartitions("box", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, sides = None, False, ([], [])
        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("box", "i", "j", "side")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if tuple(key[:3, lo]) != now:
                    if now:
                        yield from _tile_rows(int(now[0]) // count, shared.value, sides, own, how)
                    now, own, sides = tuple(key[:3, lo]), batch["own"][lo].as_py(), ([], [])
                sides[int(key[3, lo])].append(batch.slice(lo, hi - lo).select(["node", "w", "vec"]))
        if now:
            yield from _tile_rows(int(now[0]) // count, shared.value, sides, own, how)

    found = saved(dealt.mapInArrow(run, "a long, b long, n long"))
    return found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links")), found.where("b is not null").select("a", "b")


def near_duplicate_vectors(vectors: DataFrame, how: Pigeonhole = Pigeonhole(), vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: how many other rows have a cosine
    of at least ``least_cosine``, the least id it reaches by such links, and whether that is
    its own.

    Null, empty and zero vectors and vectors with a null or non-finite component link with
    nothing.  A vector shorter than the longest one counts as if it ended in zeros.  Rows
    that repeat an id or a vector are rows of their own.  A row with a null id links like
    any other; ``component_id`` is the least id that is not null, ``kept`` is false for it.
    An empty table gives no rows.  Further columns are ignored, whatever their names."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"))
    able = usable(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    longest = rows.where(able).agg(F.max(F.size("vec"))).first()[0] or 1
    full = F.when(F.size("vec") < longest, F.concat("vec", F.array_repeat(F.lit(0).cast(vectors.schema[vec].dataType.elementType), F.lit(longest) - F.size("vec")))).otherwise(F.col("vec"))
    rows = rows.withColumn("vec", F.when(able, full))
    own = node_ids(rows.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("w")), "least")
    own = own.withColumn("node", F.col("node").cast("long"))
    degree, links = near_links(own.select("node", "w", "vec"), how)
    root = saved(components(links))
    labelled = own.select("node", "least", "w").join(degree, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    told = own.select("node", "vec").join(told, "node").drop("node")
    out = rows.join(told, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def near_duplicate_vectors_sql(how: Pigeonhole = Pigeonhole()) -> str:
    return f"""WITH RECURSIVE able AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {how.least_cosine}),
reach AS (SELECT vec_id AS a, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.a),
least AS (SELECT a, min(root) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) d ON d.a = e.vec_id"""
