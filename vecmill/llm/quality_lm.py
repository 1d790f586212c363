"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is trained on trusted text (rows labelled good).  Its tokens are the bytes of
the UTF-8 text as they stand, so the vocabulary is open to any script and no word list
is needed; n-grams of five bytes tell prose from shouting, repeated signs and noise.

Counts live in shards: n-gram counts are summed by a shuffle, lower orders and the
statistics of contexts are aggregates of them, and the probability of every n-gram of the
corpus comes from joins of the corpus's distinct n-grams with these tables, order by
order.  Nothing of it is gathered in one place and no table is sent to all workers, so
order, vocabulary and corpus may grow.  Documents are dealt into groups of bounded size
(``GROUP_BYTES``), one to a partition, whose number grows with the input; a group asks the shards for its distinct n-grams and gets their probabilities,
so a text crosses the network once and an n-gram once per group.

A document is rejected when its perplexity is above its language's threshold, a quantile
of trusted documents of that language which the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import saved

SYMBOLS = 256
SHARD_CODES = 500_000  # n-grams of the corpus in a shard, about
GROUP_BYTES = 128 << 20  # text of a group, about; a single longer text is a group's


def codes(buf: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The n-gram code that ends at each byte; zero bytes stand before a document."""
    sizes = np.diff(at)
    place = np.arange(len(buf)) - np.repeat(at[:-1], sizes)
    code = np.zeros(len(buf), np.int64)
    for back in range(order - 1, -1, -1):
        symbol = np.zeros(len(buf), np.int64)
        symbol[back:] = buf[: max(0, len(buf) - back)]
        symbol[place < back] = 0
        code = code * SYMBOLS + symbol
    return code


def _slices(column: pa.Array, order: int, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, codes, code offsets) of slices of a text column of about
    ``size`` bytes; a longer text comes in several pieces of ``size``, one row each."""
    raw, offsets = K.utf8(column)
    for lo, hi in K.slices(offsets, size):
        start, stop = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or stop - start <= 2 * size:
            at = offsets[lo : hi + 1] - start
            yield lo, hi, codes(raw[start:stop], at, order), at
            continue
        for a in range(start, stop, size):
            b, before = min(a + size, stop), min(order - 1, a - start)
            piece = codes(raw[a - before : b], np.array([0, b - a + before]), order)[before:]
            yield lo, hi, piece, np.array([0, len(piece)])


class Tally:
    """Distinct codes and their counts over many slices."""

    def __init__(self):
        self.code, self.n, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, code: np.ndarray) -> None:
        self.held.append(np.unique(code, return_counts=True))
        if sum(len(c) for c, _ in self.held) > max(1 << 20, len(self.code)):
            self.settle()

    def settle(self) -> None:
        code = np.concatenate([self.code, *(c for c, _ in self.held)])
        n = np.concatenate([self.n, *(n for _, n in self.held)])
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate((np.ones(len(code[:1]), bool), code[1:] != code[:-1])))
        self.code, self.n, self.held = code[first], np.add.reduceat(n, first) if len(first) else n, []


def count_ngrams(texts: DataFrame, order: int, flush: int = 4_000_000) -> DataFrame:
    """``code long, n long`` over all texts (one string column), summed in shards.

    A task combines what it reads and hands over at most about ``flush`` n-grams at a
    time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def handed():
            tally.settle()
            return pa.RecordBatch.from_arrays([pa.array(tally.code), pa.array(tally.n)], names=["code", "n"])

        for batch in batches:
            for _, _, code, _ in _slices(batch.column(0), order):
                tally.add(code)
                if len(tally.code) > flush:
                    yield handed()
                    tally = Tally()
        yield handed()
        del tally
        _trimmed(None)

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three modified Kneser-Ney discounts from counts of counts 1 to 4."""
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 / n2), 3 - 4 * y * (n4 / n3 if n3 else 1)]
    return [min(max(x, 0.05), 0.95 * (i + 1)) for i, x in enumerate(d)]


def kneser_ney(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """From counts of the highest order to (seen, context) tables for orders 1 .. order.

    ``seen`` has ``code, head`` (the discounted share of the n-gram in its context) and
    ``context`` has ``context, gamma`` (the share that goes to the lower order).  Counts
    of lower orders are continuation counts; both come from joins on the context code."""
    levels = [saved(counts)]
    for k in range(order - 1, 0, -1):
        levels.append(saved(levels[-1].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.count("*").alias("n"))))
    out = []
    for level in reversed(levels):
        tally = {r.n: r.c for r in level.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        d1, d2, d3 = _discounts(*(tally.get(i, 0) for i in (1, 2, 3, 4)))
        rows = level.withColumn("context", F.shiftright("code", 8))
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
        seen = rows.join(context, "context").select("code", ((F.col("n") - off) / F.col("total")).alias("head"))
        out.append((seen, context.select("context", (F.col("freed") / F.col("total")).alias("gamma"))))
    return out


def probabilities(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``code, logp`` of every code in ``wanted`` (distinct codes of the highest order).

    Order by order the distinct codes meet the shards of seen n-grams, those of contexts
    and the probabilities of their suffixes; what no shard has takes the lower order's
    share, down to the uniform distribution over bytes."""
    suffixes = [saved(wanted.select("code"))]
    for k in range(order - 1, 0, -1):
        suffixes.append(saved(suffixes[-1].select((F.col("code") % SYMBOLS**k).alias("code")).distinct()))
    lower = None
    for k, (seen, context) in enumerate(kneser_ney(counts, order), 1):
        rows = suffixes[order - k].withColumn("context", F.shiftright("code", 8)).join(seen, "code", "left").join(context, "context", "left")
        below = F.lit(1.0 / SYMBOLS)
        if lower is not None:
            rows, below = rows.withColumn("suffix", F.col("code") % SYMBOLS ** (k - 1)).join(lower, "suffix"), F.col("below")
        p = F.coalesce("head", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below
        lower = saved(rows.select(F.col("code").alias("suffix"), p.alias("below")))
    return lower.select(F.col("suffix").alias("code"), F.log("below").alias("logp"))


def _scored(column: pa.Array, code: np.ndarray, logp: np.ndarray, order: int, window: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nats, bytes, n-grams that are the first of their kind in a window of ``window``
    bytes) of each text, by ascending codes and their log probabilities.

    One sort of a slice serves both: equal codes lie together, so each is looked up once
    and each place knows the place of the same code before it."""
    nats, size, fresh = np.zeros(len(column)), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for lo, hi, own, at in _slices(column, order):
        n = np.diff(at)
        size[lo:hi] += n
        if not len(own):
            continue
        by = np.argsort(own, kind="stable")
        ranked = own[by]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        found = np.searchsorted(code, ranked[first])
        each = np.empty(len(own))
        each[by] = logp[found][np.cumsum(first) - 1]
        before = np.empty(len(own), np.int64)
        before[by] = np.where(first, -1, np.concatenate(([-1], by[:-1])))
        start = np.repeat(at[:-1], n)
        place = np.arange(len(own))
        new = before < start + (place - start) // window * window
        total, seen = (np.concatenate(([0], np.cumsum(x))) for x in (each, new))
        nats[lo:hi] -= total[at[1:]] - total[at[:-1]]
        fresh[lo:hi] += seen[at[1:]] - seen[at[:-1]]
    return nats, size, fresh


def _trimmed[T](table: T) -> T:
    """The table, after what a group needed has gone back to the machine: workers serve
    later stages too, and what they hold counts against the executor."""
    K.give_back()
    return table


def _distinct(table: pa.Table, column: str, order: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's distinct codes and their order by shard."""
    tally = Tally()
    for chunk in table.column(column).chunks:
        for _, _, code, _ in _slices(chunk, order):
            tally.add(code)
    tally.settle()
    return tally.code, np.argsort(tally.code % shards, kind="stable")


def _packed(code: np.ndarray) -> bytes:
    """Ascending codes as gaps, four bytes each where that is enough."""
    gaps = np.diff(code)
    return code[:1].tobytes() + (gaps.astype(np.uint32) if len(gaps) == 0 or gaps.max() < 1 << 32 else gaps).tobytes() + bytes([int(len(gaps) > 0 and gaps.max() >= 1 << 32)])


def _unpacked(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, np.int64, 1)
    gaps = np.frombuffer(data[8:-1], np.int64 if data[-1] else np.uint32)
    return np.concatenate((first, first + np.cumsum(gaps, dtype=np.int64)))


_known_labels: dict[int, list[int]] = {}


def _labels(spark, parts: int) -> list[int]:
    """An int for each of ``parts`` hash partitions that Spark puts there, so that as many
    groups lie one to a partition."""
    n = 16 * parts
    while parts not in _known_labels:
        found = spark.range(n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("id")).collect()
        if len(found) == parts:
            _known_labels[parts] = [r.id for r in found]
        n *= 2
    return _known_labels[parts]


def document_scores(docs: DataFrame, counts: DataFrame, order: int, carry: list[str], text_col: str = "text", group_bytes: int = GROUP_BYTES, shard_codes: int = SHARD_CODES) -> DataFrame:
    """``carry`` columns, ``nats`` (negative log probability of the whole text), ``n_bytes``
    and ``variety`` (the share of the n-grams in windows of 256 bytes that are distinct
    there, 1 for an empty text) of every row; a null text is empty.

    What a task holds does not follow the input: there are as many groups as it takes to
    hold about ``group_bytes`` of text each (the session's shuffle partitions at least),
    and as many shards as it takes for about ``shard_codes`` n-grams each."""
    spark = docs.sparkSession
    p = saved(probabilities(count_ngrams(docs.select(F.col(text_col)), order), counts, order))
    shards = max(64, p.count() // shard_codes) | 1  # odd: bytes are no multiples of it
    size = docs.agg(F.sum(F.octet_length(docs[text_col])).alias("n")).first().n or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // group_bytes))
    # Inner columns get positions for names, so the rows may carry any names.
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(carry, names, strict=True)], docs[text_col].alias("text"))
    label = F.split(F.lit(",".join(map(str, _labels(spark, groups)))), ",").cast("array<int>")  # folded to one constant
    rows = rows.withColumn("part", F.get(label, F.pmod(F.xxhash64(*names, "text"), F.lit(groups)).cast("int"))).repartition(groups, "part")

    def ask(table: pa.Table) -> pa.Table:
        code, by = _distinct(table, "text", order, shards)
        shard = (code % shards)[by]
        at = np.searchsorted(shard, np.arange(shards + 1))
        some = np.flatnonzero(np.diff(at))
        return _trimmed(pa.table({"shard": pa.array(some, pa.int32()), "part": pa.array([table.column("part")[0].as_py()] * len(some), pa.int32()), "codes": pa.array([_packed(code[by[at[i] : at[i + 1]]]) for i in some.tolist()], pa.binary())}))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        code, logp = known.column("code").to_numpy(), known.column("logp").to_numpy()
        by = np.argsort(code)
        code, logp = code[by], logp[by].astype(np.float32)
        got = [logp[np.searchsorted(code, _unpacked(x))].tobytes() for x in asked.column("codes").to_pylist()]
        return pa.table({"part": asked.column("part"), "shard": asked.column("shard"), "logp": pa.array(got, pa.binary())})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        code, by = _distinct(table, "text", order, shards)
        told = sorted(zip(answers.column("shard").to_pylist(), answers.column("logp").to_pylist(), strict=True))
        logp = np.zeros(len(code))
        logp[by] = np.frombuffer(b"".join(x for _, x in told), np.float32)
        found = [_scored(chunk, code, logp, order) for chunk in table.column("text").chunks]
        nats, size, fresh = (np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in range(3))
        variety = np.where(size > 0, fresh / np.maximum(size, 1), 1.0)
        return _trimmed(pa.table({**{c: table.column(c) for c in names}, "nats": pa.array(nats, pa.float64()), "n_bytes": pa.array(size.astype(np.int64)), "variety": pa.array(variety, pa.float64())}))

    asked = rows.groupBy("part").applyInArrow(ask, "shard int, part int, codes binary")
    known = p.withColumn("shard", F.pmod("code", F.lit(shards)).cast("int"))
    told = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "part int, shard int, logp binary")
    kinds = rows.select(*names).withColumns({"nats": F.lit(0.0), "n_bytes": F.lit(0).cast("long"), "variety": F.lit(0.0)}).schema
    out = rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(score, kinds)
    return out.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def trusted_docs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bound: int = 4_000_000) -> DataFrame:
    """Rows of ``docs`` whose label is 1; the ids are broadcast only up to ``bound``."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("good_id")).dropna().distinct()
    good = F.broadcast(good) if good.count() <= bound else good
    return docs.join(good, docs[id_col] == good["good_id"], "left_semi")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = 5, quantile: float = 0.99, slack: float = 0.1, prior: float = 50.0, low_quantile: float = 0.001, held_out: int = 5, with_key: bool = False) -> DataFrame:
    """``doc_id, lang, log_ppl, perplexity, threshold, keep`` for every row.

    The model is trained on the trusted rows but every ``held_out``-th (by a hash of the
    text), which set the thresholds.  ``log_ppl`` is the mean negative log probability of
    a byte, with ``prior`` bytes of the held-out rows' mean added, so a few bytes do not
    decide.  ``threshold`` of a language is the ``quantile`` of its held-out rows plus
    ``slack`` (natural log; the quantile's own tail is good text).  The other bound is on
    repetition, which the model finds likely: a text whose variety (see
    ``document_scores``) is below the trusted rows' ``low_quantile`` goes too.  A language
    without held-out rows takes the quantile over all of them; without any everything is
    kept.  Null and empty texts are kept, null ids and languages stay, repeated rows stay,
    other columns are ignored.  ``with_key`` adds a hash of id, language and text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    share = F.pmod(F.xxhash64("text"), F.lit(held_out))
    trusted = trusted_docs(rows, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", label_col)
    counts = saved(count_ngrams(trusted.where(share != 0).select("text"), order))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "lang", "text")).withColumn("apart", share == 0)
    scored = saved(document_scores(keyed, counts, order, ["doc_id", "lang", "key", "apart"]))
    good = trusted_docs(scored, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", label_col)
    sums = good.where("apart").agg(F.sum("nats").alias("nats"), F.sum("n_bytes").alias("n")).first()
    mean = sums.nats / sums.n if sums.n else float(np.log(SYMBOLS))
    value = (F.col("nats") + prior * mean) / (F.col("n_bytes") + prior)
    cut = F.percentile_approx(F.when(F.col("apart"), value), F.lit(quantile), F.lit(10_000)).alias("cut")
    low = F.percentile_approx("variety", F.lit(low_quantile), F.lit(10_000)).alias("low")
    every = good.agg(cut, low).first()
    by_lang = good.groupBy(F.col("lang").alias("own")).agg(cut, low)
    by_lang = F.broadcast(by_lang) if by_lang.count() <= 10_000 else by_lang
    limit = F.coalesce(F.col("cut"), F.lit(every.cut).cast("double")) + slack
    least = F.coalesce(F.col("low"), F.lit(every.low).cast("double"))
    found = scored.withColumn("log_ppl", value).join(by_lang, F.col("lang").eqNullSafe(F.col("own")), "left")
    keep = (F.col("log_ppl") <= limit) & (F.col("variety") >= least)
    key = ["key"] if with_key else []
    return found.select("doc_id", "lang", *key, "log_ppl", F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(keep, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Rows of ``docs`` (all columns) that ``quality_verdicts`` keeps."""
    found = quality_verdicts(docs, labels, id_col, text_col, lang_col, with_key=True, **options)
    gone = saved(found.where("not keep").select("doc_id", "key").distinct())
    key = F.xxhash64(docs[id_col].cast("long"), docs[lang_col], docs[text_col])
    same = docs[id_col].cast("long").eqNullSafe(gone["doc_id"]) & (key == gone["key"])  # a chance hash of another id drops nothing
    return docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, same, "left_anti")
