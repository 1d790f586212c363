"""Pixels of images: decoded in tasks, some ahead of their use, and resized.

Tables hold images as bytes: PNG (every colour type and depth, not interlaced) and binary
PNM (``P5``, ``P6``, 8 bits) are decoded here, other formats by a ``decoder`` of the caller,
a function of bytes to an array.  Folders of files in the JVM's formats (JPEG, PNG, GIF,
BMP) are read by Spark's own image source.  Pixels are RGB, row by row, a byte each;
transparency is left out.  An image that cannot be read has an ``error`` and no pixels.

Decode late: choose pages by their keys (``tables.candidate_pages``) and decode what is left.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Decoder = Callable[[bytes], np.ndarray]

_FIELDS = "width int, height int, pixels binary, error string"
#: PNG colour type: samples of a pixel (fixed values of the format).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """PNG rows without their filters.  A byte follows from those to the left, above and
    between, so all pixels of a diagonal are done at once, whatever the rows' filters."""
    h, w = rows.shape[0], rows.shape[1] // step
    raw = rows.reshape(h, w, step).astype(np.int16)
    out = np.zeros((h + 1, w + 1, step), np.int16)
    for k in range(h + w - 1):
        y = np.arange(max(0, k - w + 1), min(h, k + 1))
        x = k - y
        left, above, between = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_above, to_between = abs(above - between), abs(left - between), abs(left + above - 2 * between)
        paeth = np.where((to_left <= to_above) & (to_left <= to_between), left, np.where(to_above <= to_between, above, between))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, above, (left + above) >> 1, paeth])
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(rows.shape)


def _png(data: bytes, most: int) -> np.ndarray:
    at, head, palette, packed, ended = 8, None, None, [], False
    while at + 12 <= len(data) and not ended:
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or len(head) != 13 or not ended:
        raise ValueError("a part is missing")
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    if colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16) or interlaced or not 0 < w * h <= most:
        raise ValueError("interlaced" if interlaced else "too many pixels" if w * h > most else "a broken header")
    bits = depth * _SAMPLES[colour]
    line = (w * bits + 7) // 8
    flat = zlib.decompressobj().decompress(b"".join(packed), h * (line + 1))
    if len(flat) != h * (line + 1):
        raise ValueError("rows are missing")
    rows = np.frombuffer(flat, np.uint8).reshape(h, line + 1)
    if rows[:, 0].max() > 4:
        raise ValueError("an unknown filter")
    bytes_ = _unfiltered(rows[:, 1:], rows[:, 0], max(1, bits // 8))
    if depth < 8:
        each = np.unpackbits(bytes_, axis=1)[:, : line * 8 // depth * depth].reshape(h, -1, depth)
        values = (each @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :w, None]
        if colour != 3:
            values = (values.astype(np.int32) * 255 // (2**depth - 1)).astype(np.uint8)
    else:
        values = bytes_.reshape(h, w, _SAMPLES[colour], depth // 8)[..., 0]
    if colour == 3:
        if palette is None or values.max() >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[values[..., 0]]
    return values[..., :3] if colour in (2, 6) else np.repeat(values[..., :1], 3, axis=2)


def _pnm(data: bytes, most: int) -> np.ndarray:
    found = re.match(rb"P([56])(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)\s", data)
    if not found or int(found[4]) != 255:
        raise ValueError("a broken header or not 8 bits")
    w, h, samples = int(found[2]), int(found[3]), 3 if found[1] == b"6" else 1
    if not 0 < w * h <= most:
        raise ValueError("too many pixels or none")
    body = np.frombuffer(data, np.uint8, offset=found.end())
    if len(body) < w * h * samples:
        raise ValueError("rows are missing")
    return np.repeat(body[: w * h * samples].reshape(h, w, samples), 3 // samples, axis=2)


def decode(data: bytes, decoder: Decoder | None = None, most: int = 1 << 26) -> np.ndarray:
    """``height x width x 3`` bytes of an image of at most ``most`` pixels; else an error."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data, most)
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data, most)
    if decoder is None:
        raise ValueError("an unknown format")
    pixels = np.asarray(decoder(data), np.uint8)
    if pixels.ndim != 3 or pixels.shape[2] != 3:
        raise ValueError("the decoder did not give three colours")
    return pixels


def _shares(old: int, new: int) -> np.ndarray:
    """``new x old``: which share of each new cell every old one has."""
    edges = np.arange(new + 1) * (old / new)
    low, high = np.arange(old), np.arange(1, old + 1)
    part = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return np.maximum(part, 0.0) * (new / old)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers, halves rounded up."""
    if pixels.shape[:2] == (height, width):
        return pixels
    down = np.tensordot(_shares(pixels.shape[0], height), pixels.astype(np.float64), 1)
    both = np.einsum("xw,hwc->hxc", _shares(pixels.shape[1], width), down)
    return np.floor(np.round(both, 9) + 0.5).clip(0, 255).astype(np.uint8)


def _ahead(items: Iterator, prepare: Callable, ahead: int) -> Iterator:
    """``item, prepare(item)`` in order; up to ``ahead`` items are prepared before they are due."""
    with ThreadPoolExecutor(ahead) as pool:
        waiting: deque = deque()
        for item in items:
            waiting.append((item, pool.submit(prepare, item)))
            if len(waiting) > ahead:
                first, done = waiting.popleft()
                yield first, done.result()
        while waiting:
            first, done = waiting.popleft()
            yield first, done.result()


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _pictures(chunk: pa.RecordBatch, col: str, size: tuple[str, str] | None, decoder: Decoder | None, most: int) -> list[tuple[np.ndarray | None, str | None]]:
    """Pixels and error of each image of a chunk."""
    sizes = zip(*[chunk[c].to_pylist() for c in size], strict=True) if size else [(None, None)] * chunk.num_rows
    out: list[tuple[np.ndarray | None, str | None]] = []
    for data, (w, h) in zip(chunk[col], sizes, strict=True):
        try:
            if not data.is_valid:
                raise ValueError("no image")
            pixels = decode(data.as_py(), decoder, most)
            if size and (w is None or h is None or w < 1 or h < 1 or w * h > most):
                raise ValueError("no size to bring it to")
            out.append((resize(pixels, w, h) if size else pixels, None))
        except Exception as why:  # whatever a decoder finds wrong is a property of the row
            out.append((None, str(why) or type(why).__name__))
    return out


def decoded(pages: DataFrame, col: str = "image", size: tuple[str, str] | None = None, decoder: Decoder | None = None, rows: int = 16, ahead: int = 2, most: int = 1 << 26) -> DataFrame:
    """``pages`` with ``width, height, pixels, error`` in place of the binary column ``col``.

    ``size`` names the columns of the width and height to bring every image to.  A task
    holds the pixels of ``rows * (ahead + 1)`` images.  A null image, a damaged one and one
    of more than ``most`` pixels have null pixels and an error."""
    keep = [c for c in pages.columns if c != col]
    if clash := {"width", "height", "pixels", "error"} & {c.lower() for c in keep}:
        raise ValueError(f"pages have columns of the result: {sorted(clash)}")
    kept = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(_FIELDS).fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare = lambda chunk: _pictures(chunk, col, size, decoder, most)
        for chunk, found in _ahead(_chunks(batches, rows), prepare, ahead):
            shape = [(None, None) if p is None else p.shape[:2] for p, _ in found]
            new = [[s[1] for s in shape], [s[0] for s in shape], [None if p is None else p.tobytes() for p, _ in found], [e for _, e in found]]
            columns = [chunk[c] for c in keep] + [pa.array(v, t) for v, t in zip(new, target.types[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return pages.mapInArrow(run, schema)


def encoded(pages: DataFrame, encoder: Callable, schema: str, col: str = "image", size: tuple[str, str] | None = None, decoder: Decoder | None = None, rows: int = 16, ahead: int = 2, most: int = 1 << 26) -> DataFrame:
    """Pages through a model.  ``encoder`` maps an iterator of (a frame of ``rows`` pages
    without ``col``, the list of their pixel arrays, null where unreadable) to frames of
    ``schema``; while it works on one batch the next ``ahead`` are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare = lambda chunk: _pictures(chunk, col, size, decoder, most)
        ready = _ahead(_chunks(batches, rows), prepare, ahead)
        for frame in encoder((chunk.drop_columns([col]).to_pandas(), [p for p, _ in found]) for chunk, found in ready):
            yield pa.RecordBatch.from_pandas(pd.DataFrame(frame), preserve_index=False)

    return pages.mapInArrow(run, schema)


def unreadable(images: DataFrame) -> DataFrame:
    """``error, n`` of decoded images: how many could not be read, by cause."""
    return images.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """``origin, width, height, pixels, error`` of the image files below a folder."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 16):
            rows = []
            for r in chunk.to_pylist():
                if r["nChannels"] not in (1, 3, 4):
                    rows.append({"origin": r["origin"], "width": None, "height": None, "pixels": None, "error": "an unknown format or a damaged file"})
                    continue
                p = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p[..., 2::-1]  # Spark has blue first
                rows.append({"origin": r["origin"], "width": r["width"], "height": r["height"], "pixels": rgb.tobytes(), "error": None})
            types = pa.schema([("origin", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, types)

    return raw.mapInArrow(run, f"origin string, {_FIELDS}")
