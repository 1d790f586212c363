"""Token ids in seekable binary files.

A shard is a sequence of independent zstandard frames, each the little-endian
unsigned 32-bit ids of some whole documents, then a document index and a seek table,
both in skippable frames, so the file is also a valid zstandard stream of the ids.
The seek table has the layout of the public zstandard seekable format:

    frame ... frame | index (skippable 0x184D2A50) | seek table (skippable 0x184D2A5E)

The seek table ends the file and has, per frame, compressed size, content size and
a checksum (low 32 bits of XXH64 of the content).  The index is a zstandard frame of
three arrays: document id (int64), ids before it in the shard (uint64), ids (uint32),
followed by its own checksum.  A reader takes the footer, the seek table and the
index, then decompresses only the frames that hold the requested documents.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import arrow_fs, shared_dir
from .token_counts import byte_alphabet

# Fixed values of the zstandard formats.
SEEK_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1


def _check(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Writes one shard; ``frame_ids`` is the size at which a frame is closed."""

    def __init__(self, sink, frame_ids: int = 1 << 17, level: int = 3):
        self.sink, self.frame_ids = sink, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.open: list[np.ndarray] = []
        self.pending = self.total = 0

    def add(self, docs: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append documents, whose ids lie one after the other in ``ids``."""
        ends = np.cumsum(lengths)
        self.docs.append(docs.astype(np.int64))
        self.lengths.append(lengths.astype(np.uint32))
        self.starts.append((self.total + ends - lengths).astype(np.uint64))
        self.total += len(ids)
        at = row = 0
        while row < len(lengths):  # frames end at document boundaries
            end = min(int(np.searchsorted(ends, at + self.frame_ids - self.pending)) + 1, len(lengths))
            self.open.append(ids[at : ends[end - 1]])
            self.pending += int(ends[end - 1]) - at
            at, row = int(ends[end - 1]), end
            if self.pending >= self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        if self.pending:
            content = np.concatenate(self.open).astype("<u4").tobytes()
            frame = self.pack.compress(content)
            self.sink.write(frame)
            self.seek.append((len(frame), len(content), _check(content)))
            self.open, self.pending = [], 0

    def close(self) -> None:
        self._flush()
        cat = lambda xs, kind: np.concatenate(xs).astype(kind).tobytes() if xs else b""
        content = cat(self.docs, "<i8") + cat(self.starts, "<u8") + cat(self.lengths, "<u4")
        index = self.pack.compress(content) + struct.pack("<I", _check(content))
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to one shard through a seekable file object."""

    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the shard")
        head = size - 9 - 12 * frames - 8
        self.seek = np.frombuffer(self._at(head + 8, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.seek[:, 0])))
        self.first = np.concatenate(([0], np.cumsum(self.seek[:, 1]))) // 4
        raw = self._at(int(self.offset[-1]) + 8, head - int(self.offset[-1]) - 8)
        content = self.unpack.decompress(raw[:-4])
        if _check(content) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("checksum of the document index differs")
        n = len(content) // 20
        self.docs = np.frombuffer(content, "<i8", n)
        self.starts = np.frombuffer(content, "<u8", n, 8 * n).astype(np.int64)
        self.lengths = np.frombuffer(content, "<u4", n, 16 * n).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        content = self.unpack.decompress(self._at(int(self.offset[k]), int(self.seek[k, 0])))
        if _check(content) != self.seek[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(content, "<u4")

    def read(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the given rows of the index in ascending order; each frame
        that holds one of them is decompressed once, no other."""
        held, ids = -1, np.zeros(0, np.uint32)
        for row in rows.tolist():
            start, n = int(self.starts[row]), int(self.lengths[row])
            k = int(np.searchsorted(self.first, start, side="right")) - 1
            if n and k != held:
                held, ids = k, self.frame(k)
            yield row, ids[start - self.first[k] : start - self.first[k] + n] if n else ids[:0]


# Characters other than the ASCII ones that a regular expression's \s matches.
_WIDE_SPACES = "\u0085                 　"


class Encoder:
    """Ids of texts with the ``tokenizers`` library; each distinct chunk is encoded once.

    A text is cut where its pre-tokens always end: before a single space or line
    break between other characters, after such a line break, and between a letter
    and ASCII punctuation other than an apostrophe.  A text with a special token's
    string or with white space beyond ASCII is one chunk."""

    def __init__(self, path: str, cache_entries: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [regex.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = regex.compile("|".join([*special, f"[{_WIDE_SPACES}]"]))
        self.signs = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()] + sorted({c.encode()[:2] for c in _WIDE_SPACES})
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet()) if b != 10}
        self.store = K.HashStore(cache_entries)
        self.pool, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = 0
        punct = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
        self.punct = K._table("".join(punct))
        self.letter = K._table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def _cuts(self, buf: np.ndarray, at: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
        n = len(buf)
        space = K.SPACE_BYTE[buf]
        line = buf == 10
        lone = np.zeros(n, bool)
        lone[1:-1] = ((buf == 32) | line)[1:-1] & ~space[:-2] & ~space[2:]
        cut = np.zeros(n + 1, bool)
        cut[:n] = lone
        cut[1:] |= lone & line
        latin = np.zeros(n, bool)  # second byte of a letter U+00C0 .. U+00FF
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7) & (buf[1:] >= 0x80)
        cut[1:n] |= (self.letter[buf] | latin)[:-1] & self.punct[buf][1:]
        for lo, hi in whole:
            cut[lo:hi] = False
        cut[at] = True
        cut[n] = False
        return np.flatnonzero(cut)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        single = [(t[1:] if t[:1] == " " else t).isalpha() for t in texts]  # one pre-token
        mapped = iter("\n".join([t for t, one in zip(texts, single, strict=True) if one]).encode().decode("latin-1").translate(self.alphabet).split("\n"))
        tokenize = self.tok.model.tokenize
        out: list = [[x.id for x in tokenize(next(mapped))] if one else None for one in single]
        rest = [i for i, one in enumerate(single) if not one]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and the number of each."""
        docs = len(at) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        data = buf.tobytes()
        whole = []
        if any(x in data for x in self.signs):
            whole = [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if self.odd.search(data[a:b].decode())]
        starts = self._cuts(buf, at, whole)
        ends = np.append(starts[1:], len(buf))
        keys, first, back = np.unique(K.run_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        rows = self.store.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            if self.store.full(len(new)):
                self.store.clear()
                self.at, self.size, self.used, new = self.at[:0], self.size[:0], 0, np.arange(len(keys))
            got = self._encode([data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for g in got for x in g), np.uint32, int(size.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
            self.pool[self.used : self.used + len(flat)] = flat
            rows[new] = self.store.add(keys[new])
            self.at = np.concatenate((self.at, self.used + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size.astype(np.int32)))
            self.used += len(flat)
        rows = rows[back]
        ids = self.pool[K.ragged_take(self.at[rows], self.size[rows].astype(np.int64))]
        return ids, K.sums(self.size[rows], np.searchsorted(starts, at))


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, frame_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    fs, path = arrow_fs(folder)
    part = TaskContext.get().partitionId()
    name, draft = f"{path}/part-{part:07d}.vmtk", f"{path}/.draft-{part:07d}-{uuid.uuid4().hex}"
    encoder, writer, sink, nulls = Encoder(vocabulary), None, None, 0
    for batch in batches:
        raw, offsets = K.utf8(batch.column(1))
        nulls += batch.column(0).null_count
        names = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        if writer is None and len(names):
            fs.create_dir(path, recursive=True)
            sink = fs.open_output_stream(draft)
            writer = ShardWriter(sink, frame_ids)
        for lo, hi in K.slices(offsets):
            ids, count = encoder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            size = count + 1
            out = np.full(len(ids) + len(count), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(size) - 1] = False
            out[keep] = ids
            writer.add(names[lo:hi], out, size)
    if writer is not None:
        writer.close()
        sink.close()
        fs.move(draft, name)  # a repeated attempt puts the same bytes in place
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([writer.total]), pa.array([nulls], pa.int64())], names=["shard", "path", "n_ids", "n_null"])


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = 1 << 17) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending id order.

    Shards hold consecutive ranges of ids (range partitioning; as many shards as
    shuffle partitions, so a shard's size is set as any partition's).  Returns the
    manifest, one row per shard: ``shard, path, n_ids, n_null, start`` (ids in all
    shards before it).  A null text is empty, null ids come first, rows with equal
    ids follow each other in the order of their texts, an empty table gives no shard.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = ordered.mapInArrow(lambda b: _write(b, folder, vocabulary, end_id, frame_ids), "shard int, path string, n_ids long, n_null long").collect()  # one row per shard
    found.sort(key=lambda r: r.shard)
    start, manifest = 0, []
    for r in found:
        manifest.append((r.shard, r.path, r.n_ids, r.n_null, start))
        start += r.n_ids
    return spark.createDataFrame(manifest, "shard int, path string, n_ids long, n_null long, start long")


def _read(batches: Iterator[pa.RecordBatch], folder: str, wanted: list[int] | None) -> Iterator[pa.RecordBatch]:
    fs, _ = arrow_fs(folder)
    for batch in batches:
        for path, nulls, start in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("path", "n_null", "start")), strict=True):
            with fs.open_input_file(path) as source:
                shard = ShardReader(source, source.size())
                rows = np.arange(len(shard.docs)) if wanted is None else np.flatnonzero(np.isin(shard.docs, wanted))
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    got = [ids.tobytes() for _, ids in shard.read(part)]
                    names = pa.array(shard.docs[part], mask=part < nulls)
                    yield pa.RecordBatch.from_arrays([names, pa.array(start + shard.starts[part]), pa.array(shard.lengths[part]), pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str = "file:/", doc_ids: list[int] | None = None) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32, ids`` (little-endian 32-bit ids) of the
    shards of a manifest: all documents, or only those of a given list, for which only
    the frames that hold them are read and decompressed."""
    n = max(1, manifest.count())
    shards = manifest.repartition(n, "shard")
    return shards.mapInArrow(lambda b: _read(b, folder, doc_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
