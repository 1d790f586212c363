"""Classes of rows that share bucket keys, without expanding buckets into pairs.

In each bucket every member meets the bucket's least member; after the components of
these links are known, rows across the components of a bucket are compared, block
against block.  Any two rows that share a bucket thus either end in one class or have
been compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` (the least node) of every node of an edge list ``a, b``, by
    alternating large-star and small-star steps until the edges are stars.

    Minima are aggregates, so a node with very many edges is combined before the
    shuffle; each round is written to the shared folder."""
    pairs = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def sign(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = sign(pairs)
    for _ in range(most_rounds if before.n else 1):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = sign(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def among(df: DataFrame, keys: DataFrame, key: str, bound: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` that have a partner in ``keys`` (one row per key), with its columns:
    before any shuffle where the keys are at most ``bound``, by a shuffled join beyond it."""
    return df.join(F.broadcast(keys) if keys.count() <= bound else keys, key)


def together(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], share: int = 2000) -> DataFrame:
    """Rows ``a, part, b, payload`` laid out for comparing pairs ``a, b``: each ``a`` comes
    with its own payload first (null ``b``), then its partners.  An ``a`` with more than
    ``share`` partners comes in several parts, its payload with each.  ``fetch`` gives
    ``node, payload`` of given nodes."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    wanted = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    own = saved(fetch(wanted).select("node", "payload"))
    part = F.expr("cast(pmod(xxhash64(b), parts) as int)")
    sized = pairs.join(parts, "a").select("a", part.alias("part"), "b")
    heads = parts.join(own, parts["a"] == own["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "payload")
    members = sized.join(own.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "payload")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return heads.unionByName(members).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


@dataclass(frozen=True)
class Comparer:
    """``parse`` turns a column of payloads into objects, ``same`` decides on two."""

    parse: Callable[[pa.Array], Iterable]
    same: Callable[[object, object], bool]


def compared(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], how: Comparer) -> DataFrame:
    """The pairs ``a, b`` that are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            left, right = [], []
            for a, b, item in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), how.parse(batch.column(3)), strict=True):
                if b is None:
                    head = item
                elif how.same(head, item):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return together(pairs, fetch).mapInArrow(K.thrifty(run), "a long, b long")


def node_ids(nodes: DataFrame, least: str) -> DataFrame:
    """``nodes`` with ``node``, a number of each row: the column ``least`` where it is
    distinct and never null, so that order follows the rows' ids, else any numbers.
    Written to the shared folder, so the numbers stay."""
    numbered = saved(nodes.withColumn("node", F.monotonically_increasing_id()))
    n, kinds = numbered.agg(F.count("*"), F.countDistinct(least)).first()
    return numbered.withColumn("node", F.col(least)) if n == kinds else numbered


SKETCH_SLOTS = 96


def _sketches(rows: list) -> np.ndarray:
    """Both sketches of each node; one sketch stands for two that are the same."""
    both = SKETCH_SLOTS // 8
    return np.array([[*r, *r] if len(r) < both else r for r in rows], np.int64).view(np.uint64)


def _block_links(names: list, comps: list, items: list, sketch: np.ndarray, other: list, other_comps: list, other_items: list, other_sketch: np.ndarray, same, most_apart: int) -> Iterator[tuple[int, int]]:
    """Links between two blocks of nodes, none within what is connected already."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for i, name in enumerate(names):
        d = sketch[i] ^ other_sketch
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        d &= np.uint64(0x1111111111111111)
        gap = np.bitwise_count(d).reshape(len(d), -1, SKETCH_SLOTS // 16).sum(2).min(1)
        for j in np.argsort(gap, kind="stable").tolist():  # the most alike first
            if gap[j] > most_apart:
                break
            mine, theirs = find(comps[i]), find(other_comps[j])
            if mine != theirs and same(items[i], other_items[j]):
                root[max(mine, theirs)] = min(mine, theirs)
                yield name, other[j]


def across(left: DataFrame, fetch: Callable[[DataFrame], DataFrame], how: Comparer, sketches: DataFrame, most_apart: int, share: int = 500) -> DataFrame:
    """Links across components of rows ``key, b, root``, whose buckets all hold several.

    Nodes that are connected by buckets form a group.  In a group all nodes outside its
    largest component meet all nodes, block against block: a task holds two blocks of
    about ``share`` nodes, a node is sent once for each block it meets, and no pair is a
    row unless it is a new link."""
    heads = left.groupBy("key").agg(F.min("b").alias("a"))
    group = components(left.join(heads, "key").where("a <> b").select("a", "b")).withColumnRenamed("root", "group")
    nodes = saved(left.select(F.col("b").alias("node"), F.col("root").alias("comp")).distinct().join(group, "node"))
    sizes = nodes.groupBy("group", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    main = main.select("group", F.col("main.comp").alias("largest"), F.ceil(F.col("n") / share).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("main.n")) / share).cast("int").alias("high"))
    payload = fetch(nodes.select("node")).select("node", "payload")
    rows = nodes.join(main, "group").join(payload, "node")
    rows = rows.join(sketches, "node")
    i, j = F.expr("cast(pmod(xxhash64(node), high) as int)"), F.expr("cast(pmod(xxhash64(node), wide) as int)")
    outside = rows.where("comp <> largest").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumn("role", F.lit(0))
    every = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("high") - 1))).withColumn("j", j).withColumn("role", F.lit(1))
    cols = ["group", "i", "j", "role", "node", "comp", "sketch", "payload"]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = outside.select(*cols).unionByName(every.select(*cols)).repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(block, held):
            if held[0] and held[1]:
                (an, ac, as_, ai), (bn, bc, bs, bi) = (list(zip(*h, strict=True)) for h in held)
                # Two nodes outside the largest component meet once, from the lesser one.
                got = [(a, b) for a, b in _block_links(an, ac, ai, _sketches(as_), bn, bc, bi, _sketches(bs), how.same, most_apart) if a != b]
                yield pa.RecordBatch.from_arrays([pa.array([min(g) for g in got], pa.int64()), pa.array([max(g) for g in got], pa.int64())], names=["a", "b"])

        now, held = None, ([], [])
        for batch in batches:
            meta = [batch.column(k).to_pylist() for k in range(7)]
            for g, bi, bj, role, node, comp, sketch, item in zip(*meta, how.parse(batch.column(7)), strict=True):
                if (g, bi, bj) != now:
                    yield from links(now, held)
                    now, held = (g, bi, bj), ([], [])
                held[role].append((node, comp, sketch, item))
        yield from links(now, held)

    return blocks.mapInArrow(K.thrifty(run), "a long, b long")


def met_in_blocks(left: DataFrame, extra: DataFrame, cols: list[str], share: int) -> DataFrame:
    """Rows ``group, i, j, role, node, comp, *cols`` laid out as in ``across``, for what is
    counted on numbers: role 0 are nodes outside a group's largest component, role 1 all.
    ``extra`` gives ``node, *cols``."""
    heads = left.groupBy("key").agg(F.min("b").alias("a"))
    group = components(left.join(heads, "key").where("a <> b").select("a", "b")).withColumnRenamed("root", "group")
    nodes = saved(left.select(F.col("b").alias("node"), F.col("root").alias("comp")).distinct().join(group, "node"))
    sizes = nodes.groupBy("group", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    main = main.select("group", F.col("main.comp").alias("largest"), F.ceil(F.col("n") / share).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("main.n")) / share).cast("int").alias("high"))
    rows = nodes.join(main, "group").join(extra, "node")
    i, j = F.expr("cast(pmod(xxhash64(node), high) as int)"), F.expr("cast(pmod(xxhash64(node), wide) as int)")
    outside = rows.where("comp <> largest").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumn("role", F.lit(0))
    every = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("high") - 1))).withColumn("j", j).withColumn("role", F.lit(1))
    named = ["group", "i", "j", "role", "node", "comp", *cols]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return outside.select(*named).unionByName(every.select(*named)).repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "role", "node")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 2048) -> np.ndarray:
    """How many keys each of ``left`` shares with each of ``right`` (distinct keys each)."""
    mine, theirs = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(mine, theirs)
    row, col = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(both), at_once):
        some = both[k : k + at_once]

        def incidence(keys: np.ndarray, place: np.ndarray, n: int, some=some) -> np.ndarray:
            hit = np.minimum(np.searchsorted(some, keys), len(some) - 1)
            ok = some[hit] == keys
            m = np.zeros((n, len(some)), np.float32)
            m[place[ok], hit[ok]] = 1
            return m

        out += incidence(mine, row, len(left)) @ incidence(theirs, col, len(right)).T
    return out


def voted_across(left: DataFrame, votes: int, crowd: int = 256, share: int = 500) -> DataFrame:
    """Pairs ``a, b`` of different components that share at least ``votes`` keys, of rows ``key,
    b, root`` whose buckets all hold several.

    A bucket of at most ``crowd`` members gives its pairs as rows (a member has less than
    ``crowd``).  A crowded one never does: nodes of crowded buckets meet in blocks, where
    their crowded keys are counted.  Pairs with too few votes from small buckets are
    completed with the crowded keys of both, so every key counts."""
    sizes = saved(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    if sizes.isEmpty():
        small, crowded = left, None
    else:
        marks = F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes
        small, crowded = left.join(marks, "key", "left_anti"), saved(left.join(marks, "key"))
    pairs = small.join(small.withColumnsRenamed({"b": "c", "root": "root2"}), "key").where("root < root2")
    counted = saved(pairs.groupBy(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).agg(F.count("*").alias("votes")))
    found = counted.where(F.col("votes") >= votes).select("a", "b")
    if crowded is None:
        return found
    keys = saved(crowded.groupBy(F.col("b").alias("node")).agg(F.collect_set("key").alias("keys")))  # the keys of one node
    few = counted.where(F.col("votes") < votes).join(keys.withColumnsRenamed({"node": "a", "keys": "own"}), "a").join(keys.withColumnsRenamed({"node": "b", "keys": "other"}), "b")
    more = few.where(F.col("votes") + F.size(F.array_intersect("own", "other")) >= votes).select("a", "b")
    return found.unionByName(more).unionByName(voted_in_blocks(crowded, keys, votes, share)).distinct()


def voted_in_blocks(left: DataFrame, keys: DataFrame, votes: int, share: int) -> DataFrame:
    """Pairs ``a, b`` of different components that share at least ``votes`` of ``keys`` (``node,
    keys``), counted block against block."""
    blocks = met_in_blocks(left, keys, ["keys"], share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held) -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                (an, ac, ak), (bn, bc, bk) = (list(zip(*h, strict=True)) for h in held)
                a, b = np.array(an, np.int64), np.array(bn, np.int64)
                ok = (shared_counts(list(ak), list(bk)) >= votes) & (np.array(ac, np.int64)[:, None] != np.array(bc, np.int64)[None])
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], names=["a", "b"])

        now, held = None, ([], [])
        for batch in batches:
            meta = [batch.column(k).to_pylist() for k in range(6)]
            own = (k.values.to_numpy() for k in batch.column(6))
            for g, bi, bj, role, node, comp, k in zip(*meta, own, strict=True):
                if (g, bi, bj) != now:
                    yield from pairs(held)
                    now, held = (g, bi, bj), ([], [])
                held[role].append((node, comp, k))
        yield from pairs(held)

    return blocks.mapInArrow(run, "a long, b long")


def link_voted(keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], how: Comparer, votes: int) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b``; roots ``node, root`` of linked nodes) of rows ``node, key`` whose
    keys are so long that unlike rows hardly ever share one.

    Shared keys are counted on numbers alone, and payloads are fetched only for pairs that
    share at least ``votes`` keys.  Every member of a bucket meets its least member first;
    then, in buckets that still hold several components, members of different components
    meet (``voted_across``).  Any two rows with enough shared keys thus either end in one class or
    have been compared."""
    buckets = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    members = saved(among(keyed, saved(buckets.select("key", "a")), "key").select("key", "a", F.col("node").alias("b")))
    stars = members.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes).select("a", "b")
    links = saved(compared(saved(stars), fetch, how))
    root = saved(components(links))
    label = members.join(root.withColumnRenamed("node", "b"), "b", "left").select("key", "b", F.coalesce("root", "b").alias("root"))
    mixed = label.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = saved(among(label, saved(mixed), "key"))
    if not left.isEmpty():
        more = saved(compared(saved(voted_across(left, votes)), fetch, how))
        if not more.isEmpty():
            links = saved(links.unionByName(more))
            root = saved(components(links))
    return links, root


def link_classes(keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], how: Comparer, sketches: DataFrame, most_apart: int = SKETCH_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b``; roots ``node, root`` of linked nodes) of rows ``node, key``.

    ``sketches`` (``node, sketch``: six longs of sixteen 4-bit values, or twelve of two
    signatures) leave out pairs across components that differ in more than ``most_apart``
    slots of either signature's."""
    buckets = saved(keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"))
    members = saved(among(keyed, buckets.select("key", "a"), "key").select("key", "a", F.col("node").alias("b")))
    stars = saved(members.where("a <> b").select("a", "b").distinct())
    links = saved(compared(stars, fetch, how))
    root = saved(components(links))
    # Buckets that still hold several components.
    label = members.join(root.withColumnRenamed("node", "b"), "b", "left").select("key", "b", F.coalesce("root", "b").alias("root"))
    mixed = label.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = saved(among(label, saved(mixed), "key"))
    if not left.isEmpty():
        more = saved(across(left, fetch, how, sketches, most_apart))
        if not more.isEmpty():
            links = saved(links.unionByName(more))
            root = saved(components(links))
    return links, root
