"""Cropped and edited copies of images by local descriptors.

Each image gets multiscale corners (Harris response on a pyramid), an orientation from
the intensity centroid around each, and a binary descriptor of brightness tests whose
places are turned by that orientation.  Descriptors meet in Hamming tables: a table's key
is a fixed choice of 80 of the 192 bits, long enough that unlike images hardly ever share
one.  Images that share at least two keys are compared: mutual nearest descriptors vote
for a similarity transform (every oriented match proposes one), and the pair is linked
when enough matches agree with the best proposal.  Keys and votes are counted on numbers
of images; points travel only for pairs with enough votes (see ``linking.link_voted``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import linking as L
from .storage import saved

SCALES = np.array((1.0, 0.87, 0.76, 0.66, 0.57, 0.5))
TABLES, KEY_BITS, BITS = 6, 80, 192
RADIUS = 13  # of a patch, in pixels of its scale
#: Place in the image, level of the pyramid, orientation in 256ths of a turn, descriptor.
_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("level", "u1"), ("turn", "u1"), ("bits", "<u8", BITS // 64)])


def _pnm(data: bytes) -> np.ndarray:
    parts, at = [], 2
    while len(parts) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        parts.append(int(data[at:end]))
        at = end
    w, h, most = parts
    if not 0 < most < 65536:
        raise ValueError("no such greatest value")
    n, wide = 3 if data[1:2] == b"6" else 1, most > 255
    px = np.frombuffer(data, ">u2" if wide else np.uint8, w * h * n, at + 1).reshape(h, w, n).astype(float)
    return px.mean(2) * (255.0 / most)


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, [], b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        head = chunk if kind == b"IHDR" else head
        body += [chunk] if kind == b"IDAT" else []
        at += 12 + n
    w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or laced:
        raise ValueError("not an 8-bit image without interlacing")
    inflate = zlib.decompressobj()
    raw = np.frombuffer(inflate.decompress(b"".join(body), h * (1 + w * n)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    for y in range(h):
        out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], out[y - 1] if y else np.zeros(w * n, np.uint8), n)
    px = out.reshape(h, w, n).astype(float)
    return px[:, :, :3].mean(2) if n >= 3 else px[:, :, 0]


def decode(data: bytes | None) -> np.ndarray:
    """Grey image (0 to 255) of a binary PNM (8 or 16 bits) or an 8-bit PNG that is not
    interlaced; an empty array for anything else, damaged files included."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, KeyError, TypeError, OverflowError, MemoryError, struct.error, zlib.error):
        pass
    return np.zeros((0, 0))


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """One PNG scan line."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    px, up = row.reshape(-1, n), above.reshape(-1, n).astype(int)
    if kind == 1:
        return np.cumsum(px, 0, dtype=np.uint8).ravel()
    out = np.zeros_like(px)
    left = corner = np.zeros(n, int)
    for i in range(len(px)):
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            da, db, dc = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up[i], corner))
        out[i] = (px[i] + guess) & 255
        left, corner = out[i].astype(int), up[i]
    return out.ravel()


def pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at real coordinates (clamped to the image)."""
    h, w = image.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    h, w = (max(1, int(round(n * factor))) for n in image.shape)
    yy, xx = np.mgrid[0:h, 0:w]
    return sample(image, (yy + 0.5) / factor - 0.5, (xx + 0.5) / factor - 0.5)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, edges repeated."""
    p = np.pad(a, r + 1, mode="edge")
    s = p.cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k])[: a.shape[0], : a.shape[1]] / (k * k)


@cache
def _tests() -> np.ndarray:
    """Places of the brightness tests: (2 ends, BITS, xy), fixed pseudo-random."""
    rng = np.random.default_rng(2024)
    return np.clip(rng.normal(0, RADIUS / 2.2, (2, BITS, 2)), -RADIUS + 2, RADIUS - 2)


@cache
def _disc() -> tuple[np.ndarray, np.ndarray]:
    yy, xx = np.mgrid[-9:10, -9:10]
    inside = yy * yy + xx * xx <= 81
    return yy[inside], xx[inside]


def features(image: np.ndarray, pixels: int = 144, points: int = 64, largest: int = 1 << 20) -> np.ndarray:
    """Corners over all scales as an array of ``_POINT``: the strongest, one for each
    ``pixels`` of area and at least ``points``.  The pyramid of an image of more than
    ``largest`` pixels starts at that size; places are those of the whole image."""
    shrink = min(1.0, (largest / max(image.size, 1)) ** 0.5)
    base = resized(image, shrink) if shrink < 1 else image
    found = []
    for level, scale in enumerate(SCALES if image.size else ()):
        im = base if scale == 1.0 else resized(base, scale)
        h, w = im.shape
        edge = RADIUS + 1
        if h <= 2 * edge + 2 or w <= 2 * edge + 2:
            continue
        smooth = _box(im, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[edge:-edge, edge:-edge]
        peak = inner > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = r[edge + dy : h - edge + dy, edge + dx : w - edge + dx]
                    peak &= inner > other if (dy, dx) > (0, 0) else inner >= other
        y, x = np.nonzero(peak)
        found.append((inner[y, x], y + edge, x + edge, np.full(len(y), level), smooth))
    if not found:
        return np.zeros(0, _POINT)
    strength, y, x, level = (np.concatenate([f[i] for f in found]) for i in range(4))
    best = np.lexsort((x, y, level, -strength))[: max(points, base.size // pixels)]
    out = np.zeros(len(best), _POINT)
    ends, (dy, dx) = _tests(), _disc()
    for f in found:
        own = np.flatnonzero(level[best] == f[3][0]) if len(f[3]) else np.zeros(0, int)
        if not len(own):
            continue
        k, smooth, s = best[own], _box(f[4], 2), SCALES[f[3][0]] * shrink
        patch = smooth[y[k, None] + dy, x[k, None] + dx]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = [sample(smooth, y[k, None] + sin * e[:, 0] + cos * e[:, 1], x[k, None] + cos * e[:, 0] - sin * e[:, 1]) for e in ends]
        out["bits"][own] = np.packbits(value[0] < value[1], axis=1).view("<u8")
        out["x"][own], out["y"][own], out["level"][own] = (x[k] + 0.5) / s - 0.5, (y[k] + 0.5) / s - 0.5, f[3][0]
        out["turn"][own] = np.rint(angle * 128 / np.pi).astype(int) & 255
    return out


@cache
def _choices() -> list[np.ndarray]:
    """The bits of each table's key, fixed pseudo-random."""
    rng = np.random.default_rng(1)
    return [np.sort(rng.permutation(BITS)[:KEY_BITS]) for _ in range(TABLES)]


def table_keys(points: np.ndarray) -> np.ndarray:
    """Keys of an image's descriptors, one per descriptor and table, distinct."""
    if not len(points):
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(points["bits"]).view(np.uint8).reshape(len(points), -1), axis=1)
    out = []
    for t, choice in enumerate(_choices()):
        packed = np.zeros((len(points), 16), np.uint8)
        packed[:, : KEY_BITS // 8] = np.packbits(bits[:, choice], axis=1)
        word = packed.view("<u8").astype(np.uint64)
        out.append(K.mix64(K.mix64(word[:, 0] + np.uint64(t + 1)) + word[:, 1]))
    return np.unique(np.concatenate(out)).view(np.int64)


def _nearest(a: np.ndarray, b: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Nearest descriptor in ``b`` of each in ``a``, and its distance in bits."""
    near, bits = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for lo in range(0, len(a), step):
        d = np.bitwise_count(a["bits"][lo : lo + step, None, :] ^ b["bits"][None, :, :]).sum(2, dtype=np.int16)
        near[lo : lo + step] = d.argmin(1)
        bits[lo : lo + step] = d.min(1)
    return near, bits


def agreeing(a: np.ndarray, b: np.ndarray, most_bits: int = 40, tolerance: float = 3.5) -> int:
    """Matches of two images that agree with the best similarity transform."""
    if not len(a) or not len(b):
        return 0
    near, bits = _nearest(a, b)
    i = np.flatnonzero((_nearest(b, a)[0][near] == np.arange(len(a))) & (bits <= most_bits))
    if not len(i):
        return 0
    p, q = a[i], b[near[i]]
    ratio = 1 / SCALES
    s, t = ratio[q["level"]] / ratio[p["level"]], (q["turn"].astype(float) - p["turn"]) * (np.pi / 128)
    best = 0
    for lo in range(0, len(i), 256):  # proposals
        k = slice(lo, lo + 256)
        cos, sin = (s[k] * np.cos(t[k]))[:, None], (s[k] * np.sin(t[k]))[:, None]
        dx, dy = p["x"][None, :] - p["x"][k, None], p["y"][None, :] - p["y"][k, None]
        ex = q["x"][k, None] + cos * dx - sin * dy - q["x"][None, :]
        ey = q["y"][k, None] + sin * dx + cos * dy - q["y"][None, :]
        near_enough = np.hypot(ex, ey) <= tolerance * np.maximum(1, s[k])[:, None] + 0.05 * np.hypot(dx, dy) * s[k, None]
        turn = np.abs((t[None, :] - t[k, None] + np.pi) % (2 * np.pi) - np.pi) < 0.5
        size = np.abs(np.log(s[None, :] / s[k, None])) < 0.5
        best = max(best, int((near_enough & turn & size).sum(1).max()))
    return best


def describe(media: DataFrame, id_cols: list[str], image_col: str = "image", pixels: int = 144) -> DataFrame:
    """``id_cols, digest (of the image), points (binary)`` of every row."""
    rows = media.select(*id_cols, F.unhex(F.md5(image_col)).alias("digest"), F.col(image_col).alias("image"))
    schema = rows.drop("image").withColumn("points", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            got = [features(decode(x.as_py()), pixels).tobytes() for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.binary())], names=[*batch.schema.names[:n], "points"])

    return rows.mapInArrow(run, schema)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [table_keys(np.frombuffer(x, _POINT)) for x in batch.column(1).to_pylist()]
        node = np.repeat(batch.column(0).to_numpy(), [len(g) for g in got])
        key = np.concatenate(got) if got else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(key, pa.int64())], names=["node", "key"])


def image_copies(media: DataFrame, id_cols: list[str], image_col: str = "image", pixels: int = 144, least: int = 10, votes: int = 2) -> DataFrame:
    """``id_cols, class_id, class_size, n_points, n_links`` of every row.

    ``class_id`` is the hexadecimal digest that names the class of images linked by at
    least ``least`` agreeing matches (identical images always share one); images that
    share at least ``votes`` keys are compared unless they are connected already.
    ``n_links`` counts the verified links of the row's image to different images.  An
    image that cannot be read has no points and matches only identical bytes; a null
    image is a class of its own (null ``class_id``, size 1).  Repeated rows stay, null ids
    stay, other columns are ignored, an empty table gives an empty result.  Images of
    more than 2**20 pixels are described at that size (see ``features``).
    """
    table = saved(describe(media, id_cols, image_col, pixels).withColumn("node", F.monotonically_increasing_id()))
    nodes = saved(table.where("digest is not null").groupBy("digest").agg(F.min("node").alias("node"), F.count("*").alias("copies")))

    def fetch(wanted: DataFrame) -> DataFrame:
        return L.among(table.select("node", F.col("points").alias("payload")), wanted.select("node"), "node")

    keyed = fetch(nodes).mapInArrow(_keyed, "node long, key long")
    how = L.Comparer(lambda column: [np.frombuffer(x, _POINT) for x in column.to_pylist()], lambda a, b: agreeing(a, b) >= least)
    links, root = L.link_voted(keyed, fetch, how, votes)
    both = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.join(root, "node", "left").select("node", "digest", "copies", F.coalesce("root", "node").alias("root"))
    sizes = named.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min("digest").alias("class_id"))
    named = named.join(sizes, "root").join(both, "node", "left").select("digest", "class_id", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = table.select(*id_cols, "digest", (F.length("points") / _POINT.itemsize).cast("int").alias("n_points")).join(named, "digest", "left")
    return out.select(*id_cols, F.lower(F.hex("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "n_points", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(7).normal(0, 1, (256, 64))


def vector_image(vector: np.ndarray, size: int = 96) -> np.ndarray:
    """A grey picture of a vector: a 16 x 16 field of fixed projections, enlarged."""
    v = np.zeros(64)
    v[: min(64, len(vector))] = vector[:64]
    field = (_projection() @ v).reshape(16, 16)
    yy, xx = np.mgrid[0:size, 0:size] * (15.0 / (size - 1))
    return np.clip(128 + 45 * sample(field, yy, xx), 0, 255)


def edited_copy(image: np.ndarray) -> np.ndarray:
    """A crop of three quarters with changed contrast and brightness."""
    h, w = image.shape
    return np.clip(0.85 * image[h // 8 : h // 8 + 3 * h // 4, w // 10 : w // 10 + 3 * w // 4] + 18, 0, 255)


def media_of_vectors(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The media table of the shared test data: ``vec_id, variant, image``.  Variant 0 is
    the picture of each row's vector, variant 1 an edited copy of every fiftieth id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out: list[tuple] = []
                for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    image = vector_image(np.nan_to_num(np.array(v, float))) if v is not None else None
                    out.append((i, 0, None if image is None else pgm(image)))
                    if i is not None and i % every == 0 and image is not None:
                        out.append((i, 1, pgm(edited_copy(image))))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["vec_id", "variant", "image"])

    # Vectors are small and drawing is slow: the files' splits shall not bound the tasks.
    rows = embeddings.select("vec_id", "embedding")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "vec_id long, variant int, image binary")
