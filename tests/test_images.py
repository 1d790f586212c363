"""Decoding against the JVM's decoders, resizing, damage and prefetch."""

import struct
import zlib

import numpy as np
import pytest

from vecmill.sources import images as P


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step, kinds):
    """PNG rows under the given filters, byte by byte."""
    h, n = rows.shape
    out = bytearray()
    for y in range(h):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x in range(n):
            a = int(rows[y, x - step]) if x >= step else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            nearest = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, nearest][kind]) & 255)
    return bytes(out)


def png(rows, w, colour, depth, samples, kinds=(0, 1, 2, 3, 4), extra=b"", interlaced=0):
    head = struct.pack(">IIBBBBB", w, len(rows), depth, colour, 0, 0, interlaced)
    packed = zlib.compress(filtered(rows, max(1, depth * samples // 8), kinds))
    half = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


def samples_of(seed, h, n):
    return np.random.default_rng(seed).integers(0, 256, (h, n)).astype(np.uint8)


PALETTE = chunk(b"PLTE", bytes(range(48)))
PICTURES = {
    "rgb": png(samples_of(1, 11, 21), 7, 2, 8, 3),
    "rgba": png(samples_of(2, 9, 20), 5, 6, 8, 4, (4, 3)),
    "grey": png(samples_of(3, 6, 13), 13, 0, 8, 1),
    "palette4": png(samples_of(4, 8, 5), 9, 3, 4, 1, (0, 2), PALETTE),
    "palette8": png(samples_of(5, 8, 9) % 16, 9, 3, 8, 1, extra=PALETTE),
    "rgb_tall": png(samples_of(6, 40, 6), 2, 2, 8, 3, (4,)),
}


def pages(spark, pictures):
    rows = [(k, None if v is None else bytearray(v), 4, 3) for k, v in pictures.items()]
    return spark.createDataFrame(rows, "name string, image binary, w int, h int")


def test_png_equals_the_decoder_of_the_jvm(spark, tmp_path):
    for name, data in PICTURES.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    (tmp_path / "broken.png").write_bytes(PICTURES["rgb"][:60])
    known = {r.origin.rsplit("/", 1)[-1][:-4]: r for r in P.image_folder(spark, str(tmp_path)).collect()}
    ours = {r.name: r for r in P.decoded(pages(spark, PICTURES).drop("w", "h")).collect()}
    assert known.pop("broken").error and known.keys() == ours.keys()
    for name, r in ours.items():
        assert (r.width, r.height, r.pixels, r.error) == (known[name].width, known[name].height, known[name].pixels, None), name


def test_depths_that_the_jvm_source_does_not_give():
    deep = samples_of(7, 5, 12)
    assert (P.decode(png(deep, 2, 2, 16, 3)) == deep.reshape(5, 2, 3, 2)[..., 0]).all()
    both = samples_of(8, 5, 6)
    assert (P.decode(png(both, 3, 4, 8, 2))[..., 1] == both.reshape(5, 3, 2)[..., 0]).all()
    bits = np.array([[0b10110000], [0b01000000]], np.uint8)
    assert P.decode(png(bits, 4, 0, 1, 1, (0,)))[..., 0].tolist() == [[255, 0, 255, 255], [0, 255, 0, 0]]
    two = np.array([[0b00011011]], np.uint8)
    assert P.decode(png(two, 4, 0, 2, 1, (0,)))[0, :, 2].tolist() == [0, 85, 170, 255]


def test_plain_formats():
    body = samples_of(9, 2, 9)
    assert (P.decode(b"P6\n# made here\n3 2\n255\n" + body.tobytes()) == body.reshape(2, 3, 3)).all()
    grey = P.decode(b"P5 3 2 255\n" + bytes([32, 10, 3, 4, 5, 6]))  # values that look like white space
    assert grey[..., 0].tolist() == [[32, 10, 3], [4, 5, 6]]
    assert P.decode(b"GIF", lambda data: np.zeros((2, 2, 3))).shape == (2, 2, 3)


def test_damage_is_an_error_of_the_row(spark):
    good = PICTURES["rgb"]
    flipped = bytearray(good)
    flipped[50] ^= 1
    odd = {"null": None, "empty": b"", "text": b"not an image", "short": good[:-20], "flipped": bytes(flipped), "laced": png(samples_of(1, 2, 6), 2, 2, 8, 3, interlaced=1), "none": b"P5 0 3 255\n", "cut": b"P5 3 3 255\nab", "good": good}
    found = P.decoded(pages(spark, odd), size=("w", "h"))
    rows = {r.name: r for r in found.collect()}
    assert {k for k, r in rows.items() if r.error is None} == {"good"} and rows.keys() == odd.keys()
    assert all(r.pixels is None and r.width is None for k, r in rows.items() if k != "good")
    assert (rows["good"].width, rows["good"].height, len(rows["good"].pixels)) == (4, 3, 36)
    assert rows["null"].error == "no image" and rows["laced"].error == "interlaced"
    assert sum(r.n for r in P.unreadable(found).collect()) == 8
    with pytest.raises(ValueError, match="too many"):
        P.decode(good, most=10)


def test_empty_table_and_clashing_names(spark):
    none = pages(spark, {"a": None}).where("false")
    assert P.decoded(none).collect() == [] and P.decoded(none).columns == ["name", "w", "h", "width", "height", "pixels", "error"]
    with pytest.raises(ValueError, match="columns of the result"):
        P.decoded(none.withColumnRenamed("w", "Width"))


def test_resizing_keeps_means():
    x = samples_of(10, 12, 18).reshape(12, 6, 3)
    blocks = x.reshape(3, 4, 2, 3, 3).mean(axis=(1, 3))
    assert (P.resize(x, 2, 3) == np.floor(blocks + 0.5)).all()
    assert (P.resize(x, 12, 24)[::2, ::2] == x).all()
    assert (P.resize(np.full((5, 7, 3), 9, np.uint8), 3, 4) == 9).all()


def test_a_model_gets_batches_in_order_with_few_decoded_ahead(spark):
    made = []
    steps = [at for at, (item, twice) in enumerate(P._ahead(iter(range(20)), lambda i: made.append(i) or 2 * i, 2)) if twice == 2 * item]
    assert steps == list(range(20)) and sorted(made) == steps

    def taken():
        for i in range(20):
            pulled.append(i)
            yield i

    pulled = []
    first = P._ahead(taken(), lambda i: i, 2)
    next(first)
    assert len(pulled) == 3
    first.close()

    def mean(batches):
        for frame, pixels in batches:
            assert len(pixels) <= 2
            frame["mean"] = [None if p is None else float(p.mean()) for p in pixels]
            yield frame[["name", "mean"]]

    out = {r.name: r.mean for r in P.encoded(pages(spark, PICTURES | {"bad": b"x"}), mean, "name string, mean double", rows=2).collect()}
    assert out.pop("bad") is None
    assert out == {k: float(P.decode(v).mean()) for k, v in PICTURES.items()}
