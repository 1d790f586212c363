"""Token counts by rank-synchronous array merging.

The merges of a byte-pair vocabulary are applied to many pre-tokens at once: the
symbols of a batch lie in one ragged array, each round merges, in every sequence,
all occurrences of that sequence's lowest-ranked pair, and a sequence is done when
no pair of it has a rank.  What is counted are the surviving symbols.

White space never reaches a pre-token of this vocabulary, so a text is a bag of
runs of non-space bytes; each distinct run is merged once per worker and its count
is looked up afterwards by a 64-bit hash.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .kernels import HashStore

_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class PairMerger:
    """Counts the tokens of texts for a ``tokenizers`` BPE file whose pre-tokenizer
    keeps the matches of one pattern and whose words end in a suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.products = keys[order], order.astype(np.int32), table[:, 2].astype(np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each pre-token (none is empty)."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths)
        sym[ends - 1] = self.final[raw[ends - 1]]
        seq = np.repeat(np.arange(n), lengths)
        rank = np.full(len(sym), _NONE, np.int32)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        counts = np.zeros(n, np.int64)
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.concatenate((first, [len(sym)])))
            done = best == _NONE
            counts[seq[first[done]]] = sizes[done]
            live = np.repeat(~done, sizes)
            sym, seq, rank, low = sym[live], seq[live], rank[live], np.repeat(best[~done], sizes[~done])
            if not len(sym):
                break
            hit = rank == low
            # In a run of overlapping occurrences every other one is merged, from the left.
            at = np.flatnonzero(hit)
            new_run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run_start = at[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            at = at[(at - run_start) % 2 == 0]
            sym[at] = self.products[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seq, rank, at = sym[keep], seq[keep], rank[keep], moved[at]
            # Only pairs with a merged symbol change.
            stale = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[stale] = _NONE
            stale = stale[stale + 1 < len(sym)]
            stale = stale[seq[stale] == seq[stale + 1]]
            rank[stale] = self._rank(sym[stale], sym[stale + 1])
        return counts

    def _pieces(self, text: str) -> list[bytes]:
        """Pre-tokens: composed, folded character by character, matched by the pattern."""
        if not text.isascii():
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        else:
            text = text.lower()
        return [m.encode() for m in self.pattern.findall(text)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string counts as one token."""
        extra = np.zeros(len(texts), np.int64)
        pieces: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self.split is not None and "<" in text:
                parts = self.split.split(text)
                extra[i] = len(parts) - 1
            own = [p for part in parts for p in self._pieces(part)]
            sizes[i] = len(own)
            pieces += own
        distinct: dict[bytes, int] = {}
        index = np.fromiter((distinct.setdefault(p, len(distinct)) for p in pieces), np.int64, len(pieces))
        found = self.merged(list(distinct))
        return extra + K.sums(found[index] if len(index) else index, np.concatenate(([0], np.cumsum(sizes))))


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int, cache_entries: int) -> Iterator[pa.RecordBatch]:
    merger, store, known = PairMerger(path), HashStore(cache_entries), np.zeros(0, np.int32)
    for batch in batches:
        raw, offsets = K.utf8(batch.column(1))
        tokens = np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in K.slices(offsets):
            buf, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, runs_at = K.runs(~K.SPACE_BYTE[buf], at)
            if not len(starts):
                continue
            keys, first, back = np.unique(K.run_hashes(buf, starts, ends), return_index=True, return_inverse=True)
            rows = store.find(keys)
            new = np.flatnonzero(rows < 0)
            if len(new):
                if store.full(len(new)):
                    store.clear()
                    known, new = known[:0], np.arange(len(keys))
                data = buf.tobytes()
                texts = [data[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                found = merger.count(texts)
                rows[new] = store.add(keys[new])
                known = np.concatenate((known, found.astype(np.int32)))
            tokens[lo:hi] = K.sums(known[rows][back], runs_at)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 3_000_000) -> DataFrame:
    """Count the tokens of every whole text without any shuffle.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (more tokens than ``limit``),
    one row per input row: repeated rows and equal ids stay.  A null text is empty
    (0 tokens), a null id stays null, other columns are ignored, an empty table
    gives an empty result.  ``vocabulary`` is the path of the tokenizer file;
    ``cache_entries`` bounds the distinct runs a worker remembers.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        lambda batches: count_batches(batches, vocabulary, limit, cache_entries),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
