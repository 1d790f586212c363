"""Vector expressions on array columns, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norm floors: pooled vectors and encoder outputs are clamped differently.
POOL_EPS = 1e-8
ENCODER_EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; accumulates in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a higher-order function an outer
    expression would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2(v: Column, eps: float = ENCODER_EPS) -> Column:
    """Divide by the norm, or by ``eps`` where the norm is smaller."""
    return let(doubles(v), lambda w: let(F.greatest(norm(w), F.lit(eps)), lambda n: F.transform(w, lambda x: x / n)))


def prefix(v: Column, dim: int, eps: float = ENCODER_EPS) -> Column:
    """The first ``dim`` components, renormalised.  Apply it once per row, before any join."""
    return l2(F.slice(v, 1, dim), eps)


def axis_position(index: Column, size: Column) -> Column:
    """Place on an axis of ``size`` evenly spaced points from 0 to 1."""
    return F.when(size > 1, index / (size - 1)).otherwise(F.lit(0.0)).cast("double")


def grid_position(token: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """(x, y) of a token in raster order."""
    return axis_position(F.pmod(token, width), width), axis_position(F.floor(token / width), height)


def frequencies(dim: int) -> list[float]:
    """``10000 ** (-i / (q - 1))`` for the ``q = max(1, dim // 4)`` bands of an encoding."""
    q = max(1, dim // 4)
    return [10000.0 ** (-i / max(1, q - 1)) for i in range(q)]


def sinusoidal(x: Column, y: Column, dim: int, eps: float = POOL_EPS) -> Column:
    """Sine and cosine of both coordinates *divided* by each frequency, padded with zeros
    or cut to ``dim`` components, L2-normalised."""
    bands = F.array(*[F.lit(f) for f in frequencies(dim)])
    part = lambda f, p: F.transform(bands, lambda w: f(p / w))
    full = F.concat(part(F.sin, x), part(F.cos, x), part(F.sin, y), part(F.cos, y), F.array_repeat(F.lit(0.0), dim))
    return l2(F.slice(full, 1, dim), eps)


def fuse(v: Column, position: Column, weight: float, eps: float = POOL_EPS) -> Column:
    """``L2((1 - w) L2(v) + w p)``."""
    return l2(F.zip_with(l2(v, eps), position, lambda a, b: a * (1 - weight) + b * weight), eps)


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def smooth_l1(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def positive_grade(score: Column) -> Column:
    """Grade of a judgement: null and 0 count as 1; not-a-number and negatives give null."""
    g = F.coalesce(F.nullif(score.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when((g > 0) & ~F.isnan(g), g)


def stripped(text: Column) -> Column:
    """All white space removed from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pick(pool: Column, key: Column, epoch: int) -> Column:
    """One element of a pool, by a hash of the row's key and the epoch."""
    return F.element_at(pool, (F.pmod(F.xxhash64(key, F.lit(epoch)), F.size(pool)) + 1).cast("int"))


def trim_padding(tokens: Column, value: float = 0.0, side: str = "left") -> Column:
    """A bag without the vectors at one end all of whose components equal ``value``."""
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    real = F.filter(F.transform(tokens, lambda v, i: F.when(F.exists(v, lambda x: x != value), i + 1)), lambda i: i.isNotNull())
    first = F.array_min(real)
    last = F.array_max(real)
    kept = F.slice(tokens, first, F.size(tokens) - first + 1) if side == "left" else F.slice(tokens, F.lit(1), last)
    return F.when(F.size(real) == 0, F.slice(tokens, 1, 0)).otherwise(kept)


def masked(tokens: Column, mask: Column) -> Column:
    """The tokens whose place in a boolean array is set: padding dropped."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda r: r["m"]), lambda r: r["t"])


def zeroed(tokens: Column, mask: Column) -> Column:
    """The tokens as they are where the mask is set and zero vectors elsewhere."""
    return F.zip_with(tokens, mask, lambda v, m: F.when(m, v).otherwise(F.transform(v, lambda x: x * 0)))


def image_mask(token_ids: Column, image_token: int) -> Column:
    """Which token ids are the image token."""
    return F.transform(token_ids, lambda t: t == image_token)


def patches(width: Column, height: Column, patch: int = 16, merge: int = 2, least: int = 65536, most: int = 16777216) -> tuple[Column, Column]:
    """(across, down) token grid of an image: sides are rounded to multiples of the merged
    patch and, where the area is out of bounds, scaled to fit them keeping the aspect."""
    f = float(patch * merge)
    near = lambda x: F.greatest(F.lit(f), F.bround(x / f) * f)
    h, w = near(height), near(width)
    shrink = F.sqrt(height.cast("double") * width / most)
    grow = F.sqrt(F.lit(float(least)) / (height.cast("double") * width))
    down = lambda x: F.greatest(F.lit(f), F.floor(x / shrink / f) * f)
    up = lambda x: F.ceil(x * grow / f) * f
    side = lambda whole, x: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(whole)
    return F.floor(side(w, width) / f).cast("int"), F.floor(side(h, height) / f).cast("int")
