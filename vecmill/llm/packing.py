"""Best-fit packing of documents into sequences of several permitted lengths.

Packing depends only on how many pieces there are of each length, so the plan is made
on the histogram of lengths, which has at most as many entries as the largest capacity
whatever the corpus.  Always for the longest piece left, every permitted capacity is
filled best-fit (the longest piece that still fits, again and again), the capacity with
the least cost per token is opened, and the bin is downsized to the smallest capacity
that holds its contents; the pattern is repeated as often as its pieces last, so each
step uses up some length.  Pieces then find their bin by their rank among the pieces of
their length: ranks come from counts by salted shards, so no length is numbered by one
task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


@dataclass
class Slots:
    """Intervals of ranks: pieces of ``length`` with ranks from ``start`` go, ``per``
    to a bin, to bins from ``bin`` on, at ``offset`` in the bin."""

    length: np.ndarray
    start: np.ndarray
    per: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    capacity: np.ndarray
    used: np.ndarray


def fill(capacity: int, first: int, lengths: list[int], left: dict[int, int]) -> Counter:
    """Pieces of one bin: ``first``, then always the longest that still fits."""
    taken, room = Counter({first: 1}), capacity - first
    while room:
        at = bisect_right(lengths, room) - 1
        while at >= 0 and left[lengths[at]] <= taken[lengths[at]]:
            at -= 1
        if at < 0:
            break
        n = min(room // lengths[at], left[lengths[at]] - taken[lengths[at]])
        taken[lengths[at]] += n
        room -= n * lengths[at]
    return taken


def plan(histogram: dict[int, int], capacities: list[int], overhead: float = 16.0) -> list[tuple[int, int, int, Counter]]:
    """(capacity, contents, repeats, pieces by length) of each pattern of bins.

    The cost of a bin is its capacity plus ``overhead``.  Lengths are from 1 to the
    largest capacity."""
    sizes, left = sorted(capacities), {k: n for k, n in histogram.items() if n}
    lengths, out = sorted(left), []
    while lengths:
        longest = lengths[-1]
        best = None
        for c in sizes:
            if c < longest:
                continue
            taken = fill(c, longest, lengths, left)
            used = sum(k * n for k, n in taken.items())
            fits = next(s for s in sizes if s >= used)  # downsizing
            cost = (fits + overhead) / used
            if best is None or cost < best[0] - 1e-12:
                best = (cost, fits, used, taken)
        _, fits, used, taken = best
        repeats = min(left[k] // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= repeats * n
        lengths = [k for k in lengths if left[k]]
        out.append((fits, used, repeats, taken))
    return out


def slots(patterns: list[tuple[int, int, int, Counter]]) -> Slots:
    rows, done, bins = [], Counter(), 0
    for capacity, used, repeats, taken in patterns:
        offset = 0
        for k in sorted(taken, reverse=True):
            rows.append((k, done[k], taken[k], bins, offset, capacity, used))
            done[k] += repeats * taken[k]
            offset += k * taken[k]
        bins += repeats
    rows.sort()
    return Slots(*(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 7)))


def pieces(lengths: DataFrame, largest: int, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """``doc_id, piece, start, length``: a document longer than the largest capacity is
    cut into full pieces and a rest; null and negative lengths count as 0."""
    n = F.greatest(F.coalesce(lengths[length_col].cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = lengths.select(lengths[id_col].cast("long").alias("doc_id"), n.alias("n"))
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("long"))).alias("piece"))
    start = F.col("piece") * largest
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest).cast("long")).alias("length"))


def pack(lengths: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), id_col: str = "doc_id", length_col: str = "n_tokens", overhead: float = 16.0, shard_rows: int = 50_000) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_offset, bin_capacity, bin_used``.

    One row per piece; pieces of a bin do not overlap and no bin is over its capacity.
    A document without tokens has one piece of length 0 and null bin columns.  Ties are
    broken by id and piece; repeated rows are packed as often as they occur; null ids
    come first; an empty table gives an empty result.
    """
    largest = max(capacities)
    rows = saved(pieces(lengths, largest, id_col, length_col))
    sized = rows.where("length > 0")
    tally = {r.length: r.n for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most the largest capacity
    table = slots(plan(tally, list(capacities), overhead))
    shards = max(1, -(-max(tally.values(), default=0) // shard_rows))
    # Rank among the pieces of a length: pieces in earlier shards, then inside the shard.
    salted = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("inside", inside).join(offsets, ["length", "shard"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("inside")).alias("rank"))
    shared = lengths.sparkSession.sparkContext.broadcast(table)  # bounded by the capacities

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t.length << 40 | t.start
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 4))
            at = np.searchsorted(key, length.astype(np.int64) << 40 | rank, side="right") - 1
            within = rank - t.start[at]
            cols = (t.bin[at] + within // t.per[at], t.offset[at] + within % t.per[at] * length, t.capacity[at], t.used[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, cols)], names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_capacity", "bin_used"])

    placed = numbered.mapInArrow(place, "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_capacity long, bin_used long")
    none = [F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_capacity", "bin_used")]
    return placed.unionByName(rows.where("length = 0").select("doc_id", "piece", "start", "length", *none))


def pack_documents(docs: DataFrame, vocabulary: str, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pack whole texts by their token counts (see ``token_counts``)."""
    from .token_counts import token_counts

    return pack(saved(token_counts(docs, vocabulary, id_col=id_col, text_col=text_col)), capacities, **options)
