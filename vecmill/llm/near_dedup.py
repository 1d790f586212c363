"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Each distinct shingle of a document is a Poisson process whose rate is its weight
(1 + ln of its count); arrivals fall on signature slots at random and every slot keeps
the first.  Two documents agree in a slot with the probability Jaccard similarity of
their weights, which is plain Jaccard where all weights are 1: a text that repeats
shingles has a second signature with such weights, for others both are the same.
Arrivals later than the fullest slot's time change nothing, so elements
stop early.  Bands of slots give candidates, exact similarity decides.

Groups are never expanded into all pairs.  In each band bucket every member meets the
bucket's least member (see ``linking``); after the components of these links are known,
a bucket whose members lie in different components is looked at again, and of the texts
across components those are compared, block against block, whose signatures agree nearly
as often as similar texts' do.  Any pair that shares a bucket thus either ends in one class, or has been
compared, or is apart by more than four standard deviations of its estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import linking as L
from .storage import free_name, saved

_U64 = np.uint64
_LOW = 44  # bits of a shingle's hash; the bits above hold the document while sorting


def weighted_shingles(column: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (first row, last row, document, shingle, count); documents from 0 in each
    slice, shingles distinct and ascending within a document."""
    raw, offsets = K.utf8(K.lowered(column))
    for lo, hi in K.slices(offsets):
        for a in range(lo, hi, 1 << 19):
            b = min(hi, a + (1 << 19))
            at = offsets[a : b + 1] - offsets[a]
            sh, sat = K.shingles(*K.words(raw[offsets[a] : offsets[b]], at), width)
            doc = np.repeat(np.arange(b - a, dtype=_U64), np.diff(sat))
            key = np.sort(doc << _U64(_LOW) | sh >> _U64(64 - _LOW))
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate((first, [len(key)])))
            key = key[first]
            yield a, b, (key >> _U64(_LOW)).astype(np.int64), key & _U64((1 << _LOW) - 1), count


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures (docs x slots, at most 2048 slots) of element hashes; rows of empty
    documents are 0."""
    if slots > 2048:
        raise ValueError("a slot is drawn from 11 bits")
    best = np.full(docs * slots, np.inf)
    owner = np.zeros(docs * slots, _U64)
    seed, t = K.mix64(element.astype(_U64) + _U64(0x9E37)), np.zeros(len(element))
    rate, d, done, width = weight.astype(float), doc, 0, 1
    while len(seed):
        step = np.arange(done, done + width, dtype=_U64) * _U64(0xD1342543DE82EF95)
        bits = K.mix64((seed[:, None] + step[None, :]).ravel()).reshape(len(seed), width)
        gap = -np.log(((bits >> _U64(11)).astype(float) + 0.5) / (1 << 53)) / rate[:, None]
        time = t[:, None] + np.cumsum(gap, 1)
        slot = ((bits & _U64(0x7FF)) * _U64(slots) >> _U64(11)).astype(np.int64) + d[:, None] * slots
        flat_time, flat_slot = time.ravel(), slot.ravel()
        np.minimum.at(best, flat_slot, flat_time)
        won = flat_time == best[flat_slot]
        owner[flat_slot[won]] = np.repeat(seed, width)[won]
        t, done = time[:, -1], done + width
        live = t < best.reshape(docs, slots).max(1)[d]
        seed, t, rate, d = seed[live], t[live], rate[live], d[live]
        width = int(min(64, 2 * width)) if len(seed) * width < 1 << 18 else width
    return owner.reshape(docs, slots)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (ascending distinct elements, weights)."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], y[order]
    at = np.searchsorted(r, r)  # equal ratios count on the side of x
    above = np.append(np.cumsum(xs[::-1])[::-1], 0)[at]
    below = np.concatenate(([0], np.cumsum(ys)))[at]
    both = (xs > 0) & (ys > 0)
    return float((1 / (above[both] / xs[both] + below[both] / ys[both])).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], floor: float = 0.0) -> float:
    """The greater of plain and probability Jaccard; below ``floor`` possibly only a
    bound that is below it too."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    plain = common / (len(a[0]) + len(b[0]) - common)
    if plain >= floor or plain < floor / 3:
        return plain
    return max(plain, probability_jaccard(a, b))


def signatures(docs: DataFrame, slots: int, bands: int, width: int) -> DataFrame:
    """``digest, doc_id, keys, sketch`` per row: the text's digest, one 64-bit key per band
    and four bits of each of the first slots; of texts that repeat shingles also those of
    the signature with all weights 1."""
    rows_per = slots // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix64(np.arange(1, bands + 1, dtype=_U64))
        factor = K.mix64(np.arange(101, 101 + rows_per, dtype=_U64)) | _U64(1)
        place = np.arange(16, dtype=_U64) * _U64(4)
        for batch in batches:
            for lo, hi, doc, sh, count in weighted_shingles(batch.column(2), width):
                weighted = prob_minhash(doc, sh, weights(count), hi - lo, slots)
                twice = np.bincount(doc[count > 1], minlength=hi - lo) > 0
                sel = twice[doc]
                plain = weighted.copy()
                plain[twice] = prob_minhash((np.cumsum(twice) - 1)[doc[sel]], sh[sel], np.ones(int(sel.sum())), int(twice.sum()), slots)
                sig = np.stack((weighted, plain), 1)
                keys = K.mix64((sig.reshape(hi - lo, 2, bands, rows_per) * factor).sum(3, dtype=_U64) + salt).view(np.int64)
                nibble = (sig[:, :, : L.SKETCH_SLOTS] >> _U64(40) & _U64(15)).reshape(hi - lo, 2, -1, 16)
                sketch = (nibble << place).sum(3, dtype=_U64).view(np.int64)
                some = np.bincount(doc, minlength=hi - lo) > 0
                used = np.stack((np.repeat(some[:, None], bands, 1), keys[:, 0] != keys[:, 1]), 1)
                at = np.concatenate(([0], np.cumsum(used.sum((1, 2))))).astype(np.int32)
                seen = np.stack((np.ones(hi - lo, bool), twice), 1)
                six = pa.array(np.concatenate(([0], np.cumsum(seen.sum(1) * sketch.shape[2]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[used])), pa.ListArray.from_arrays(six, pa.array(sketch[seen].ravel()))],
                    names=["digest", "doc_id", "keys", "sketch"],
                )

    return docs.select("digest", "doc_id", "text").mapInArrow(K.thrifty(run), "digest binary, doc_id long, keys array<long>, sketch array<long>")


def _parsed(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and weights of each text."""
    for lo, hi, doc, sh, count in weighted_shingles(column, width):
        at, w = np.searchsorted(doc, np.arange(hi - lo + 1)), weights(count)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield sh[a:b].copy(), w[a:b].copy()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, slots: int = 96, bands: int = 24) -> DataFrame:
    """``doc_id, class_id, class_size, kept, node`` (the text's digest) per row.

    Two texts are linked when the plain or the probability Jaccard similarity of their
    five-word shingles is at least ``threshold``; equal texts always belong together;
    classes are connected components and ``class_id`` is the least ``doc_id`` of a class.
    ``kept`` marks one row of each class (of equal ids, or where all are null, only one).  Texts under five words
    have one shingle, texts without words match only equal texts.  A null text is a class
    of its own, as is each row with a null id if its text matches nothing; an empty table
    gives an empty result; other columns are ignored.

    With 24 bands of 4 slots a pair at 0.8 by either measure shares no bucket with
    probability 3e-6, and is left out by its signatures with one below 1e-4.
    """
    if slots < L.SKETCH_SLOTS:
        raise ValueError(f"at least {L.SKETCH_SLOTS} slots")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))  # md5 of null is null
    texts = rows.where("text is not null")
    table = saved(signatures(texts, slots, bands, width))
    nodes = table.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = L.node_ids(nodes, "least")

    def fetch(wanted: DataFrame) -> DataFrame:
        own = nodes.select("node", "digest").join(wanted, "node")
        return L.among(texts.select("digest", F.col("text").alias("payload")), own, "digest").dropDuplicates(["node"])

    # A slot's four bits agree with the similarity plus a sixteenth of the rest; four
    # standard deviations below that at the threshold.
    agree = threshold + (1 - threshold) / 16
    most_apart = int(L.SKETCH_SLOTS * (1 - agree) + 4 * (L.SKETCH_SLOTS * agree * (1 - agree)) ** 0.5)
    how = L.Comparer(lambda column: _parsed(column, width), lambda a, b: similarity(a, b, threshold) >= threshold)
    _, root = L.link_classes(nodes.select("node", F.explode("keys").alias("key")), fetch, how, nodes.select("node", "sketch"), most_apart)
    # Least id of each class, then one row per input row.
    with_root = nodes.join(root, "node", "left").select("digest", "least", "copies", F.coalesce("root", "node").alias("root"))
    classes = with_root.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest")).alias("lead"))
    by_text = saved(with_root.join(classes, "root").where("class_size > 1").select("digest", "class_id", "class_size", F.col("lead.digest").alias("lead")))
    big = F.broadcast(by_text) if by_text.count() <= 500_000 else by_text
    out = rows.select("doc_id", "digest").join(big, "digest", "left")
    out = out.select("doc_id", F.col("digest").alias("node"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("lead", "digest").alias("lead"))
    # Rows that repeat an id and a text come in turn; rows without a text never repeat.
    turn = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy("class_id"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("lead"))
    kept = first & (turn == 1) | F.col("node").isNull()
    return out.select("doc_id", "class_id", "class_size", kept.alias("kept"), "node")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``near_duplicate_classes`` keeps."""
    found = saved(near_duplicate_classes(docs, id_col, text_col, **options).select("doc_id", "node", "kept"))
    kept = found.where("kept and node is not null").select(F.col("doc_id").alias("own_id"), F.col("node").alias("own"))
    repeated = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("node") == F.col("own"))
    dropped = found.where("not kept").select("doc_id", "node").join(kept, repeated, "left_anti")
    name = free_name(docs, "node")
    mark = docs.withColumn(name, F.unhex(F.md5(docs[text_col])))
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= 500_000 else gone
    same = mark[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (mark[name] == gone["gone"])
    left = mark.join(gone, same, "left_anti")
    if not found.where("not kept").join(kept, repeated, "left_semi").isEmpty():  # repeated rows
        left = left.where(F.col(name).isNull()).unionByName(left.where(F.col(name).isNotNull()).dropDuplicates([id_col, name]))
    return left.drop(name)
