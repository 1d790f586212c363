"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents.  Jaccard similarity of a short
and a long set is tiny, so sizes are partitioned: items fall into classes of at most
1, 2, 4, 8, ... shingles, and for a class of size ``u`` a document is a sequence of
windows of two adjacent blocks of ``u`` shingles, so that any run of ``u`` shingles lies
in one window and an item of the class has a Jaccard similarity of about 0.2 to 0.4
with it.  A window and an item that agree in one of ``hashes`` minima are candidates,
which the exact containment of the item's shingles in the whole document decides.

Block minima are computed once for the smallest class; larger blocks are minima of
smaller ones.  The search is map-only: the index of the items is sent to the workers
in blocks whose bytes are bounded, so that one reading of the documents serves all items
of a test set up to that size (some hundred thousand), and as many readings as blocks
beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_U32 = np.uint32


def _minhash_input(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(32)).astype(_U32)


def _factors(hashes: int) -> np.ndarray:
    return K.mix64(np.arange(1, hashes + 1, dtype=np.uint64)).astype(_U32) | _U32(1)


def _permuted(x: np.ndarray, factor: np.uint32) -> np.ndarray:
    y = x * factor
    y ^= y >> _U32(15)
    y *= _U32(0x2C1B3C6D)
    y ^= y >> _U32(13)
    return y


class ItemIndex:
    """Shingles of a block of test items and their minima by size class."""

    def __init__(self, ids: list, texts: list[str | None], width: int = 5, hashes: int = 48):
        self.ids, self.hashes, self.width = ids, hashes, width
        raw, offsets = K.utf8(K.lowered(pa.array(texts, pa.string())))
        word, at = K.words(raw, offsets)
        self.widths = np.minimum(np.diff(at), width)  # a short item is one shingle of all its words
        sh, sat = K.shingles(word, at, width)
        # Distinct shingles of each item, ascending.
        item = np.repeat(np.arange(len(ids)), np.diff(sat))
        order = np.lexsort((sh, item))
        sh, item = sh[order], item[order]
        new = np.concatenate((np.ones(len(sh[:1]), bool), (sh[1:] != sh[:-1]) | (item[1:] != item[:-1])))
        self.shingles, item = sh[new], item[new]
        self.at = np.searchsorted(item, np.arange(len(ids) + 1))
        sizes = np.diff(self.at)
        factor = _factors(hashes)
        x = _minhash_input(self.shingles)
        some = np.flatnonzero(sizes)
        block = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        # (width of shingles, block) -> per hash the sorted minima, their items, and a
        # table of bits that tells most other values apart
        self.classes: dict[tuple[int, int], tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = {}
        groups = {(int(w), int(u)): some[(self.widths[some] == w) & (block[some] == u)] for w, u in set(zip(self.widths[some].tolist(), block[some].tolist(), strict=True))}
        for key, members in groups.items():
            bits = min(25, max(16, int(64 * len(members)).bit_length()))
            self.classes[key] = ([], [], np.zeros((hashes, (1 << bits) // 8), np.uint8))
        for k in range(hashes):
            least = np.minimum.reduceat(_permuted(x, factor[k]), self.at[some]) if len(some) else x
            minima = np.zeros(len(ids), _U32)
            minima[some] = least
            for key, members in groups.items():
                values, owners, present = self.classes[key]
                v = minima[members]
                order = np.argsort(v, kind="stable")
                values.append(v[order])
                owners.append(members[order].astype(np.int32))
                place = v & _U32(present.shape[1] * 8 - 1)
                np.bitwise_or.at(present[k], place >> _U32(3), np.left_shift(1, place & _U32(7)).astype(np.uint8))

    def own(self, item: int) -> np.ndarray:
        return self.shingles[self.at[item] : self.at[item + 1]]

    @property
    def nbytes(self) -> int:
        return self.shingles.nbytes + sum(sum(map(lambda a: a.nbytes, (*v, *o, p))) for v, o, p in self.classes.values())


def _joined(minima: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of adjacent blocks inside each document (blocks twice as long)."""
    sizes = np.diff(at)
    into = np.concatenate(([0], np.cumsum((sizes + 1) // 2)))
    if not len(minima):
        return minima, into
    pair = np.repeat(at[:-1], (sizes + 1) // 2) + 2 * (np.arange(into[-1]) - np.repeat(into[:-1], (sizes + 1) // 2))
    return np.minimum.reduceat(minima, pair), into


def candidates(shingle: np.ndarray, at: np.ndarray, index: ItemIndex, width: int) -> np.ndarray:
    """Distinct (document, item) rows that agree in a minimum of a window."""
    classes = {block: c for (w, block), c in index.classes.items() if w == width}
    if not classes or not len(shingle):
        return np.zeros((0, 2), np.int64)
    x, sizes, least = _minhash_input(shingle), np.diff(at), min(classes)
    n_blocks = -(-sizes // least)
    base_at = np.concatenate(([0], np.cumsum(n_blocks)))
    start = np.repeat(at[:-1], n_blocks) + least * (np.arange(base_at[-1]) - np.repeat(base_at[:-1], n_blocks))
    found = []
    for k, factor in enumerate(_factors(index.hashes)):
        minima, mat, block = np.minimum.reduceat(_permuted(x, factor), start), base_at, least
        while block <= max(classes):
            if block in classes:
                values, owners, present = classes[block]
                # A window is a block and the next one of the same document.
                last = np.zeros(len(minima) + 1, bool)
                last[mat] = True
                window = minima.copy()
                if len(minima) > 1:
                    np.minimum(window[:-1], minima[1:], out=window[:-1], where=~last[1:-1])
                place = window & _U32(present.shape[1] * 8 - 1)
                hit = np.flatnonzero(present[k, place >> _U32(3)] >> (place & _U32(7)).astype(np.uint8) & np.uint8(1))
                if len(hit):
                    lo, hi = np.searchsorted(values[k], window[hit]), np.searchsorted(values[k], window[hit], side="right")
                    item = owners[k][K.ragged_take(lo, hi - lo)]
                    doc = np.searchsorted(mat, np.repeat(hit, hi - lo), side="right") - 1
                    found.append(doc * len(index.ids) + item)
            minima, mat = _joined(minima, mat)
            block *= 2
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.stack([pairs // len(index.ids), pairs % len(index.ids)], 1)


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex, threshold: float) -> Iterator[pa.RecordBatch]:
    widths = sorted({w for w, _ in index.classes})
    for batch in batches:
        raw, offsets = K.utf8(K.lowered(batch.column(1)))
        rows, items, shared = [], [], []
        for lo, hi in K.slices(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            word, wat = K.words(raw[offsets[lo] : offsets[hi]], at)
            for width in widths:
                sh, sat = K.shingles(word, wat, width)
                doc_now, own = -1, None
                for doc, item in candidates(sh, sat, index, width).tolist():
                    if doc != doc_now:
                        doc_now, own = doc, np.sort(sh[sat[doc] : sat[doc + 1]])
                    want = index.own(item)
                    at_own = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    n = int((own[at_own] == want).sum())
                    if n >= threshold * len(want) - 1e-9:
                        rows.append(lo + doc)
                        items.append(item)
                        shared.append(n)
        if rows:
            size = np.diff(index.at)[items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[i] for i in items], pa.int64()), pa.array(np.array(shared) / size), pa.array(shared, pa.int32()), pa.array(size.astype(np.int32))],
                names=["doc_id", "item_id", "containment", "n_shared", "n_item"],
            )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5, hashes: int = 48, block_bytes: int = 48 << 20, index_bytes: int = 1 << 30) -> DataFrame:
    """``doc_id, item_id, containment, n_shared, n_item`` for each document row and item
    with at least ``threshold`` of the item's distinct five-word shingles in it.

    An item of fewer words is one shingle of that many words; an item without words, a
    null text and an empty table match nothing; null ids stay null; repeated rows repeat
    their matches.  Items are indexed in blocks of about ``block_bytes`` of text, and an
    index of more than ``index_bytes`` is an error rather than a broadcast; the documents
    are read once for each block.  An item with ``threshold`` of its shingles in one run of a
    document is missed with a probability below 1e-4 (48 minima at similarity 0.19).
    """
    spark = docs.sparkSession
    listed = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("item_text")).where("item_text is not null")
    size = listed.agg(F.sum(F.octet_length("item_text") + 64).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    out = None
    for b in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).orderBy("item_id", "item_text").collect()  # a block of the test set
        index = ItemIndex([r.item_id for r in own], [r.item_text for r in own], width, hashes)
        if index.nbytes > index_bytes:
            raise ValueError(f"an index of {index.nbytes} bytes: take smaller blocks")
        shared = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(lambda batches, shared=shared: _search(batches, shared.value, threshold), "doc_id long, item_id long, containment double, n_shared int, n_item int")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no test item.

    Rows are told apart by id and text digest, so an id used twice drops only the row
    that matched."""
    from .storage import saved

    key = F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), docs[text_col])
    keyed = docs.select(key.alias("own_key"), docs[text_col].alias("own_text"))
    gone = saved(contaminated(keyed, items, "own_key", "own_text", **options).select(F.col("doc_id").alias("gone_key")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, key == gone["gone_key"], "left_anti")
