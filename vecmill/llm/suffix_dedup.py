"""Exact removal of repeated byte strings by blockwise suffix sorting.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier (in a
row with a smaller id, or earlier in the same text; rows of one id with different texts
come in the order of a hash of the text).

Only suffixes that can have an equal elsewhere are sorted.  Every window of ``length``
bytes is represented by its leftmost least k-gram (its anchor), which depends on the
window's bytes alone, so equal windows have equal anchors.  The windows of one anchor
form a segment; anchors are dealt into suffix buckets by hash, one bucket is worked on
at a time, and

* an anchor that occurs once has no repeated window;
* of equal segments only the first is looked at further, the others are repeats;
* the first occurrences of an anchor's different segments are sorted as suffixes: by
  their first eight bytes, and long ties by ranks that a sample of positions was given
  beforehand.  The sample is a difference cover modulo 8 ({0, 1, 2, 4}); segments are
  laid out with their anchors at multiples of 8, so two windows that may be equal reach
  sampled positions at the same shift and one comparison of ranks settles the tie.

Memory is bounded by a bucket (a share of the anchors, as many as make about
``BUCKET_BYTES``) and a block of segments, not by the corpus or the number of partitions.
Within a batch equal segments are combined before the shuffle.  Where an anchor alone
outgrows a bucket, its segments are settled in a second round, dealt by the segment: that
it has several kinds is known by then, and equal ones still meet.  The segments
of an anchor with very many different ones (text around a passage that very many
documents share) are split further: equal windows have their anchor at one place and
begin alike, so each window goes to the suffix bucket of its anchor, that place and its
first bytes, after a sort in its task has left one of equal windows.  The same sorting
then settles these smaller buckets.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import saved

_U64 = np.uint64
_POS = 24  # low bits of a composite key: the place in a slice
BATCH_BYTES = 4 << 20
BLOCK_BYTES = 3 << 19
BUCKET_BYTES = 16 << 20  # entries of a suffix bucket, about
COVER = (0, 1, 2, 4)  # difference cover modulo 8
_SHIFT = np.array([0, 0, 0, 1, 0, 3, 2, 1])  # to the next covered residue
CUT_BYTES = 16 << 20  # of cut texts that may be broadcast
_NULL_ID = np.iinfo(np.int64).min


class Anchors:
    """Segments of a slice: anchor hash, segment hash, row, first and last window start
    relative to the text, and the anchor's place relative to the first window."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, length: int, gram: int):
        n, span = len(buf), length - gram + 1
        total = np.zeros(n + 1, _U64)
        np.cumsum(K.BYTE_CODES[buf] * K._powers("up", max(n, 1))[:n], out=total[1:])
        down = K._powers("down", n + 1)
        sizes = np.diff(at)
        starts_n = np.maximum(sizes - length + 1, 0)  # windows of each text
        empty = np.zeros(0, np.int64)
        self.hash = self.segment = np.zeros(0, _U64)
        self.row = self.first = self.last = self.anchor = empty
        if not starts_n.sum():
            return
        h = K.mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        m = h >> _U64(_POS) << _U64(_POS) | np.arange(len(h), dtype=_U64)
        size = 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        place = K.ragged_take(at[:-1], starts_n)
        anchor = (m[place] & _U64((1 << _POS) - 1)).astype(np.int64)
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        lo = np.flatnonzero(new)
        hi = np.concatenate((lo[1:], [len(anchor)])) - 1
        self.anchor_at, first, last = anchor[lo], place[lo], place[hi]
        self.hash = h[self.anchor_at]
        end = last + length
        raw = (total[end] - total[first]) * down[first]
        self.segment = K.mix64(raw + (end - first).astype(_U64) * _U64(0xD6E8FEB86659FD93)) ^ K.mix64((self.anchor_at - first).astype(_U64))
        self.row = np.searchsorted(at, first, side="right") - 1
        base = at[self.row]
        self.first, self.last, self.anchor = first - base, last - base, self.anchor_at - first


def _pieces(offsets: np.ndarray, length: int, size: int = 1 << 19) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte) of slices; a long text comes in
    several pieces that overlap by ``length - 1`` bytes, so each window is in one."""
    for lo, hi in K.slices(offsets, size):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 4 * size:
            yield lo, hi, a, b
        else:
            for start in range(a, b, size):
                yield lo, hi, start, min(b, start + size + length - 1)
                if start + size + length - 1 >= b:
                    break


def _scan(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per batch of texts: one row per bucket with its distinct segments, and one row
    (bucket -1) with the texts' digests and all segments."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        raw, offsets = K.utf8(batch.column(2))
        rid = batch.column(0).to_numpy(zero_copy_only=False)
        ids = batch.column(1).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        nulls = np.asarray(batch.column(1).is_null())
        for lo, hi in K.slices(offsets, BATCH_BYTES):
            got = []
            for a, b, start, end in _pieces(offsets[lo : hi + 1], length):
                at = np.clip(offsets[lo + a : lo + b + 1], start, end) - start
                x = Anchors(raw[start:end], at, length, gram)
                shift = start - int(offsets[lo + a]) if b - a == 1 else 0
                got.append((x.hash, x.segment, x.row + a, x.first + shift, x.last + shift, x.anchor))
            h, s, row, first, last, anchor = (np.concatenate(c) for c in zip(*got, strict=True))
            doc = ids[lo:hi][row]
            bucket = (h >> _U64(33)).astype(np.int64) % buckets
            order = np.lexsort((first, doc, s, h, bucket))
            h, s, row, first, last, anchor, doc, bucket = (c[order] for c in (h, s, row, first, last, anchor, doc, bucket))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1]))) if len(h) else np.zeros(0, bool)
            entry = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            several = np.diff(np.concatenate((at, [len(h)]))) > 1
            name = part << 32 | seq
            seq += 1
            eb = bucket[at]
            cut = np.flatnonzero(np.concatenate(([True], eb[1:] != eb[:-1]))) if len(at) else at
            stop = np.concatenate((cut[1:], [len(at)])) if len(at) else at
            out_b, out_base, blobs = [], [], []
            for c, d in zip(cut.tolist(), stop.tolist(), strict=True):
                e = at[c:d]
                blobs.append(b"".join((h[e].tobytes(), s[e].tobytes(), doc[e].tobytes(), first[e].astype(np.int32).tobytes(), several[c:d].tobytes())))
                out_b.append(int(eb[c]))
                out_base.append(c)
            digests = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]].tobytes()).hexdigest() for i in range(lo, hi)]
            head = pickle.dumps((rid[lo:hi], ids[lo:hi], nulls[lo:hi], np.diff(offsets[lo : hi + 1]), digests, entry.astype(np.uint32), row.astype(np.uint32), first.astype(np.uint32), (last - first).astype(np.uint8), anchor.astype(np.uint8), h[at]))
            k = len(out_b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*out_b, -1 - name % buckets], pa.int32()), pa.array([name] * (k + 1), pa.int64()), pa.array([*out_base, -1], pa.int32()), pa.array([*blobs, head], pa.binary())],
                names=["bucket", "batch", "base", "blob"],
            )


_ENTRY = np.dtype([("index", "<u4"), ("hash", "<u8"), ("segment", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("several", "?")])
_LOOSE = np.dtype([("index", "<u4"), ("segment", "<u8"), ("doc", "<i8"), ("first", "<i4")])


def _with_blobs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows whose last column comes as bytes one at a time, not all at once."""
    *others, blobs = batch.columns
    return zip(*(c.to_pylist() for c in others), (b.as_py() for b in blobs), strict=True)


def _entries(base: int, blob: bytes) -> np.ndarray:
    n = len(blob) // 29
    e = np.empty(n, _ENTRY)
    e["index"] = np.arange(base, base + n)
    for name, kind, at in (("hash", _U64, 0), ("segment", _U64, 8), ("doc", np.int64, 16), ("first", np.int32, 24), ("several", bool, 28)):
        e[name] = np.frombuffer(blob, kind, n, at * n)
    return e


def _told(names: list[int], sizes: list[int], take: np.ndarray, index: np.ndarray, verdict: np.ndarray) -> Iterator[tuple]:
    """Rows of verdicts (none is 0) of the entries ``take`` of several batches."""
    take, index, verdict = take[verdict > 0], index[verdict > 0], verdict[verdict > 0]
    order = np.argsort(take, kind="stable")
    at = np.searchsorted(take[order], np.cumsum([0, *sizes]))
    for name, a, b in zip(names, at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b > a:
            yield None, name, 0, index[order[a:b]].astype(np.uint32).tobytes() + verdict[order[a:b]].astype(np.uint8).tobytes()


def _settle(names: list[int], held: list[np.ndarray]) -> Iterator[tuple]:
    """One bucket: verdicts on every batch's entries.  1: an equal segment starts
    earlier elsewhere; 2: the first of several equal ones; 3: the first of its kind, and
    its anchor has other segments too."""
    e = np.concatenate(held)
    order = np.argsort(e["hash"], kind="stable")
    hs = e["hash"][order]
    new = np.concatenate(([True], hs[1:] != hs[:-1]))
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(hs)])))
    order = order[np.repeat(size > 1, size) | e["several"][order]]  # the rest occurs once
    if not len(order):
        return
    e, take = e[order], order
    order = np.lexsort((e["first"], e["doc"], e["segment"], e["hash"]))
    e, take = e[order], take[order]
    h, doc, first = e["hash"], e["doc"], e["first"]
    new_h = np.concatenate(([True], h[1:] != h[:-1]))
    new_s = new_h | np.concatenate(([True], e["segment"][1:] != e["segment"][:-1]))
    kinds = np.bincount((np.cumsum(new_h) - 1)[new_s])[np.cumsum(new_h) - 1]
    lead = np.flatnonzero(new_s)[np.cumsum(new_s) - 1]
    is_first = (doc == doc[lead]) & (first == first[lead])
    verdict = np.where(~is_first, 1, np.where(kinds > 1, 3, np.where(e["several"], 2, 0)))
    yield from _told(names, [len(x) for x in held], take, e["index"], verdict)


def _crowded(held: list[np.ndarray], most: int) -> np.ndarray:
    """Anchors of more than ``most`` entries and of several kinds of segments, in order."""
    h, s = (np.concatenate([e[c] for e in held]) for c in ("hash", "segment"))
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    end = np.concatenate((at[1:], [len(h)]))
    return h[at[(end - at > most) & (s[at] != s[end - 1])]]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("bucket", pa.int32()), ("batch", pa.int64()), ("base", pa.int32()), ("blob", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _settle_all(batches: Iterator[pa.RecordBatch], buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Verdicts and the texts' own rows (without bucket); entries of anchors that alone
    outgrow ``limit`` bytes go on, with the bucket of their segment."""
    names: list[int] = []
    held: list[np.ndarray] = []
    crowd, size, bound, bucket = np.zeros(0, _U64), 0, limit, None

    def loose(name: int, e: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        at = np.minimum(np.searchsorted(crowd, e["hash"]), len(crowd) - 1)
        gone = crowd[at] == e["hash"]
        out, some = e[gone], []
        if len(out):
            own = (out["segment"] >> _U64(33)).astype(np.int64) % buckets
            order = np.argsort(own, kind="stable")
            sent = np.empty(len(out), _LOOSE)
            for c in _LOOSE.names:
                sent[c] = out[c][order]
            cut = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
            some = [(int(own[order[a]]), name, -2, x.tobytes()) for a, x in zip(cut.tolist(), np.split(sent, cut[1:]), strict=True)]
        return e[~gone], some

    for batch in batches:
        for b, name, base, blob in _with_blobs(batch):
            if b < 0:
                yield _rows([(None, name, -1, blob)])
                continue
            if b != bucket:
                if held:
                    yield _rows(list(_settle(names, held)))
                names, held, crowd, size, bound, bucket = [], [], np.zeros(0, _U64), 0, limit, b
            e = _entries(base, blob)
            if len(crowd):
                e, some = loose(name, e)
                if some:
                    yield _rows(some)
            names.append(name)
            held.append(e)
            size += e.nbytes
            if size > bound:
                more = _crowded(held, max(1, limit // (8 * _ENTRY.itemsize)))
                if len(more):
                    crowd = np.union1d(crowd, more)
                    for i, e in enumerate(held):
                        held[i], some = loose(names[i], e)
                        if some:
                            yield _rows(some)
                    size = sum(e.nbytes for e in held)
                bound = max(limit, 2 * size)  # many anchors, or one kind: its copies come once a batch
    if held:
        yield _rows(list(_settle(names, held)))


def _settle_loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on segments of crowded anchors, which have other kinds besides."""
    names: list[int] = []
    held: list[np.ndarray] = []
    bucket = None

    def settle() -> pa.RecordBatch:
        e = np.concatenate(held)
        take = np.lexsort((e["first"], e["doc"], e["segment"]))
        e = e[take]
        new = np.concatenate(([True], e["segment"][1:] != e["segment"][:-1]))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        is_first = (e["doc"] == e["doc"][lead]) & (e["first"] == e["first"][lead])
        return _rows(list(_told(names, [len(x) for x in held], take, e["index"], np.where(is_first, 3, 1))))

    for batch in batches:
        for b, name, _, blob in _with_blobs(batch):
            if b != bucket:
                if held:
                    yield settle()
                names, held, bucket = [], [], b
            names.append(name)
            held.append(np.frombuffer(blob, _LOOSE))
    if held:
        yield settle()


_REPEATS = np.dtype([("lo", "<u4"), ("hi", "<u4")])
_OPEN = np.dtype([("hash", "<u8"), ("lo", "<u4"), ("hi", "<u4"), ("anchor", "<u4")])


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch of texts after the other: verdicts first, then the texts' own row."""
    name, verdicts = None, []
    for batch in batches:
        for b, base, blob in _with_blobs(batch):
            if b != name:
                name, verdicts = b, []
            if base >= 0:
                verdicts.append(blob)
                continue
            rid, ids, nulls, size, digests, entry, row, first, more, anchor, h = pickle.loads(blob)
            mark = np.zeros(len(h), np.uint8)
            for v in verdicts:
                n = len(v) // 5
                mark[np.frombuffer(v, np.uint32, n)] = np.frombuffer(v, np.uint8, n, 4 * n)
            own = mark[entry]
            lead = np.concatenate(([True], entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, bool)
            # Rows that repeat an id and a text at one place are one occurrence.
            lead_at = np.flatnonzero(lead)[entry] if len(entry) else entry
            lead = (ids[row] == ids[row[lead_at]]) & (first == first[lead_at]) if len(entry) else lead
            repeat, still = (own == 1) | ((own >= 2) & ~lead), (own == 3) & lead
            spans, opens = np.zeros(int(repeat.sum()), _REPEATS), np.zeros(int(still.sum()), _OPEN)
            spans["lo"], spans["hi"] = first[repeat], first[repeat] + more[repeat]
            opens["hash"], opens["lo"], opens["hi"], opens["anchor"] = h[entry[still]], first[still], first[still] + more[still], anchor[still]
            by = np.argsort(row[repeat], kind="stable"), np.argsort(row[still], kind="stable")
            at = np.searchsorted(row[repeat][by[0]], np.arange(len(rid) + 1)), np.searchsorted(row[still][by[1]], np.arange(len(rid) + 1))
            spans, opens = spans[by[0]], opens[by[1]]
            cut = lambda x, a, i: x[a[i] : a[i + 1]].tobytes() if a[i + 1] > a[i] else None
            r = range(len(rid))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(ids, mask=nulls), pa.array(size.astype(np.int64)), pa.array(digests), pa.array([cut(spans, at[0], i) for i in r], pa.binary()), pa.array([cut(opens, at[1], i) for i in r], pa.binary())],
                names=["rid", "doc_id", "n_bytes", "digest", "spans", "opens"],
            )


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments that have rivals."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for rid, doc, opens, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            for h, lo, hi, anchor in np.frombuffer(opens, _OPEN).tolist():
                for c, v in zip(cols, (h - (1 << 64) if h >> 63 else h, _NULL_ID if doc is None else doc, rid, lo, anchor, data[lo : hi + length]), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["hash", "doc", "rid", "lo", "anchor", "bytes"])


def _dense_rank(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by several keys, equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_k = k[order]
        new[1:] |= sorted_k[1:] != sorted_k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def window_ranks(text: np.ndarray, places: np.ndarray, group: np.ndarray, length: int = 100) -> np.ndarray:
    """Dense ranks of the windows of ``length`` bytes (96 to 100) at ``places``, by group,
    then in suffix order up to ties.  Places of one group are equal modulo 8, and
    ``text`` has at least 128 bytes after the last place's window."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    pack = lambda at: np.ascontiguousarray(words[at]).view(">u8").ravel().astype(_U64)
    # The cover's sample near the places, ranked by 8, 16, 32, 64 bytes.
    near = np.zeros(len(text), bool)
    shifted = places + _SHIFT[places % 8]
    for step in range(0, 96, 8):
        near[shifted + step] = True
    sample = np.flatnonzero(near)
    at = np.full(len(text) + 128, len(sample), np.int64)
    at[sample] = np.arange(len(sample))
    word = pack(sample)
    rank = np.append(np.unique(word, return_inverse=True)[1] + 1, 0)
    by = {8: rank}
    for size in (8, 16, 32):
        nxt = at[sample + size]
        pair = rank[:-1] << 32 | rank[nxt]
        rank = np.append(np.unique(pair, return_inverse=True)[1] + 1, 0)
        by[2 * size] = rank
    tail = pack(places + length - 8)
    return _dense_rank(group, pack(places), by[64][at[shifted]], by[32][at[shifted + 64]], tail)


def repeats_in_block(hashes: np.ndarray, docs: np.ndarray, los: np.ndarray, anchors: np.ndarray, segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment number, window start) of all windows of a block that start earlier too."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    # Lay out: every anchor at a multiple of 8.
    lead = -anchors % 8
    room = (lead + sizes + 7) // 8 * 8
    start = np.cumsum(room) - room + lead
    text = np.zeros(int(room.sum()) + 256, np.uint8)
    text[K.ragged_take(start, sizes)] = np.frombuffer(b"".join(segments), np.uint8)
    n = sizes - length + 1
    number = np.repeat(np.arange(len(segments)), n)
    offset = K.ragged_take(np.zeros(len(n), np.int64), n)
    group = _dense_rank(hashes[number], anchors[number] - offset)
    alone = np.bincount(group)[group] < 2
    number, offset, group = number[~alone], offset[~alone], group[~alone]
    if not len(number):
        return number, offset
    rank = window_ranks(text, start[number] + offset, group, length)
    doc, place = docs[number], los[number] + offset
    order = np.lexsort((place, doc, rank))
    r, d, p = rank[order], doc[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    lead_at = first[np.cumsum(np.concatenate(([True], r[1:] != r[:-1]))) - 1]
    again = (d != d[lead_at]) | (p != p[lead_at])
    return number[order[again]], place[order[again]]


def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor hash, in blocks that end between anchors."""

    def flush(rows):
        if len(rows) < 2:
            return
        h, doc, rid, lo, anchor, data = zip(*rows, strict=True)
        number, place = repeats_in_block(np.array(h), np.array(doc), np.array(lo, np.int64), np.array(anchor, np.int64), list(data), length)
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order]
        at = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else number
        spans = np.zeros(len(number), _REPEATS)
        spans["lo"] = spans["hi"] = place
        stop = np.concatenate((at[1:], [len(number)])) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array([rid[i] for i in number[at]], pa.int64()), pa.array([spans[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary())], names=["rid", "more"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK_BYTES and held and row[0] != held[-1][0]:
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    yield from flush(held)


def _spread(batches: Iterator[pa.RecordBatch], length: int, flush: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Windows of segments as segments of their own, keyed by anchor, place and first
    bytes.  Of equal windows among those in memory all but the first are repeats: they
    come as ``late`` rows without bytes."""
    names = ["hash", "doc", "rid", "lo", "anchor", "bytes", "late"]

    def combined(rows: list[tuple]) -> pa.RecordBatch:
        h, doc, rid, lo, anchor, data = zip(*rows, strict=True)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        n = sizes - length + 1
        text = np.frombuffer(b"".join(data), np.uint8)
        number, offset = np.repeat(np.arange(len(n)), n), K.ragged_take(np.zeros(len(n), np.int64), n)
        start = (np.cumsum(sizes) - sizes)[number] + offset
        windows = np.lib.stride_tricks.sliding_window_view(text, length)[start]
        doc, rid, place, at = np.array(doc)[number], np.array(rid)[number], np.array(lo)[number] + offset, np.array(anchor)[number] - offset
        words = np.ascontiguousarray(windows[:, :16]).view("<u8").astype(_U64)
        key = K.mix64(K.mix64(K.mix64(np.array(h, np.int64).view(_U64)[number] + at.astype(_U64)) ^ words[:, 0]) ^ words[:, 1])
        whole = np.ascontiguousarray(windows).view(np.dtype((np.void, length))).ravel()
        _, kind = np.unique(whole, return_inverse=True)
        order = np.lexsort((place, doc, kind, key))
        same = np.concatenate(([False], (key[order][1:] == key[order][:-1]) & (kind[order][1:] == kind[order][:-1])))
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        # A row that repeats both id and text is the same occurrence.
        late = same & ((doc[order] != doc[order][lead]) | (place[order] != place[order][lead]))
        keep = late | ~same
        o, late = order[keep], late[keep]
        sent = pa.array([None if x else windows[i].tobytes() for i, x in zip(o.tolist(), late.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key[o].view(np.int64)), pa.array(doc[o]), pa.array(rid[o]), pa.array(place[o].astype(np.int32)), pa.array(at[o].astype(np.int32)), sent, pa.array(late)], names=names)

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += (len(row[5]) - length + 1) * length
            if size >= flush:
                yield combined(held)
                held, size = [], 0
    if held:
        yield combined(held)


def removed_mask(size: int, spans: bytes, length: int) -> np.ndarray:
    """Bytes covered by windows that start in the given ranges (both ends included)."""
    s = np.frombuffer(spans, _REPEATS)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, s["lo"].astype(np.int64), 1)
    np.add.at(edge, np.minimum(s["hi"].astype(np.int64) + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(batches: Iterator[pa.RecordBatch], length: int, text_out: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for rid, doc, size, digest, spans, more, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            mask = removed_mask(len(data), (spans or b"") + b"".join(more or ()), length)
            raw = np.frombuffer(data, np.uint8)
            kept = raw[~mask].tobytes()
            runs = int((mask & ~np.concatenate(([False], mask[:-1]))).sum())
            for c, v in zip(out, (rid, doc, size, int(mask.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if text_out else None), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _ordered(rows: DataFrame, parts: int) -> tuple[DataFrame | None, int]:
    """(``rid, place``: numbers in the order of id and text, where an id has several texts;
    nothing where each id has one; bytes of all texts)."""
    pairs = rows.groupBy("doc_id", "rid").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    least = F.coalesce("doc_id", F.lit(_NULL_ID))  # a null id sorts as the least number
    n = pairs.agg(F.count("*").alias("texts"), F.countDistinct(least).alias("ids"), F.sum("n_bytes").alias("n_bytes")).first()
    if n.texts == n.ids:
        return None, n.n_bytes or 0
    by = pairs.select("doc_id", "rid").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "rid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "rid")
    return saved(by.withColumn("place", F.monotonically_increasing_id())), n.n_bytes or 0  # grows with the ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 24, hot: int = 20_000, keep_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row (with ``keep_text``
    also ``kept_text``, null where nothing goes, and ``rid``, a hash of id and text where an
    id has several texts, else null).

    A null text is empty; texts under ``length`` bytes lose nothing; rows that repeat
    both id and text count as one document and get the same result; rows of one id with
    different texts are documents in the order of ``rid``; a null id sorts before all
    others and stays null; overlaps count; strings are judged on the input.
    ``kept_text`` drops what the cut leaves of a divided character.  Other columns are
    ignored, an empty table gives an empty result.  ``hot`` is the number of different
    segments from which an anchor's windows are sorted in smaller buckets, and
    ``bucket_bytes`` the size of a suffix bucket, whose number grows with the input; the
    result depends on neither.
    """
    if not 96 <= length <= 104 - 4 or gram >= length:
        raise ValueError("the cover's ranks serve lengths of 96 to 100")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.xxhash64(docs[id_col].cast("long"), docs[text_col]).alias("rid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    order, size = _ordered(rows, parts)
    buckets = max(2 * parts, 3 * size // (4 * bucket_bytes))  # some 29 bytes for each 39 of text
    how = (parts, buckets, 4 * bucket_bytes, length, gram, hot, keep_text)
    # Inside, a document is a number of its own: its id, or its place where ids repeat.
    if order is None:
        numbered = rows.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("rid"), "doc_id", "text")
        out = _repeats(numbered, *how).withColumn("rid", F.lit(None).cast("long"))
    else:
        same = (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))
        placed = rows.join(order.withColumnsRenamed({"rid": "r", "doc_id": "d"}), same)
        out = _repeats(placed.select(F.col("place").alias("rid"), F.col("place").alias("doc_id"), "text"), *how)
        out = out.drop("doc_id").withColumnRenamed("rid", "place").join(order, "place")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select("rid", *cols, "kept_text") if keep_text else out.select(*cols)


def _repeats(rows: DataFrame, parts: int, buckets: int, limit: int, length: int, gram: int, hot: int, keep_text: bool) -> DataFrame:
    dealt = rows.mapInArrow(K.thrifty(lambda b: _scan(b, buckets, length, gram)), "bucket int, batch long, base int, blob binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = "bucket int, batch long, base int, blob binary"
    settled = saved(dealt.mapInArrow(K.thrifty(lambda b: _settle_all(b, buckets, limit)), told), big_rows=True)
    loose, verdicts = settled.where("bucket is not null"), settled.where("bucket is null")
    if not loose.isEmpty():
        loose = loose.repartition(parts, "bucket").sortWithinPartitions("bucket")
        verdicts = verdicts.unionByName(saved(loose.mapInArrow(K.thrifty(_settle_loose), told), big_rows=True))
    by_batch = verdicts.drop("bucket").repartition(parts, "batch").sortWithinPartitions("batch", F.col("base").desc())
    found = saved(by_batch.mapInArrow(K.thrifty(_by_text), "rid long, doc_id long, n_bytes long, digest string, spans binary, opens binary"))

    def texts_of(flagged: DataFrame) -> DataFrame:
        keys = flagged.select("rid").distinct()
        keys = F.broadcast(keys) if keys.count() <= 1_000_000 else keys
        return rows.select("rid", "text").join(keys, "rid", "left_semi").dropDuplicates(["rid"])

    still = found.where("opens is not null").dropDuplicates(["rid"]).select("rid", "doc_id", "opens")
    kinds = "hash long, doc long, rid long, lo int, anchor int, bytes binary"
    segs = saved(still.join(texts_of(still), "rid").mapInArrow(K.thrifty(lambda b: _segments(b, length)), kinds))
    many = saved(segs.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("hash"))
    none = many.isEmpty()
    many = F.broadcast(many) if many.count() <= 1_000_000 else many
    few, late = segs, None
    if not none:
        few = segs.join(many, "hash", "left_anti")
        crowd = saved(segs.join(many, "hash", "left_semi").mapInArrow(K.thrifty(lambda b: _spread(b, length)), f"{kinds}, late boolean"))
        few, late = few.unionByName(crowd.where("not late").drop("late")), crowd.where("late").select("rid", "lo")
    few = few.repartition(parts, "hash").sortWithinPartitions("hash")
    more = few.mapInArrow(K.thrifty(lambda b: _resolve(b, length)), "rid long, more binary")
    if late is not None:
        u4 = F.expr("unhex(concat(lpad(hex(lo & 255), 2, '0'), lpad(hex((lo >> 8) & 255), 2, '0'), lpad(hex((lo >> 16) & 255), 2, '0'), lpad(hex((lo >> 24) & 255), 2, '0')))")
        more = more.unionByName(late.select("rid", F.concat(u4, u4).alias("more")))
    more = saved(more.groupBy("rid").agg(F.collect_list("more").alias("more")))  # a text's own windows
    joined = found.join(more, "rid", "left")
    changed = saved(joined.where("spans is not null or more is not null").select("rid", "doc_id", "n_bytes", "digest", "spans", "more"))
    same = joined.where("spans is null and more is null")
    same = same.select("rid", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    cut = changed.join(texts_of(changed), "rid").mapInArrow(K.thrifty(lambda b: _finish(b, length, keep_text)), same.schema)
    return same.unionByName(cut)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (all columns) with repeated strings cut from the texts."""
    cut = saved(remove_repeats(docs, id_col, text_col, keep_text=True, **options).where("n_removed > 0").select("rid", "doc_id", "kept_text").distinct())
    size = cut.agg(F.sum(F.octet_length("kept_text") + 64).alias("n"), F.count("rid").alias("hashed")).first()
    same = docs[id_col].cast("long").eqNullSafe(cut["doc_id"])
    if size.hashed:  # ids of several texts
        same &= F.xxhash64(docs[id_col].cast("long"), docs[text_col]) == cut["rid"]
    both = docs.join(F.broadcast(cut) if (size.n or 0) <= CUT_BYTES else cut, same, "left")
    return both.select(*[F.coalesce(cut["kept_text"], docs[text_col]).alias(c) if c == text_col else docs[c] for c in docs.columns])
