"""Target-distribution importance resampling of documents, in DataFrame functions only.

A document's words become an array of buckets; buckets are counted over both corpora, and
each bucket has a gain, the log ratio of its shares.  A document is scored by one
aggregate over its own array, which looks each bucket up in a literal array of gains, so
scoring neither explodes nor shuffles: only count totals do.  Gumbel noise, made from the
id, turns the largest scores into a sample without replacement.

Null and empty texts have no features and weight 0.  A row with a null id counts in the
corpus but has no score and is never drawn.  Rows that repeat an id are drawn separately;
ties go to the smaller id, then to fewer features.  An empty table gives an empty result,
an empty target leaves the gains to the smoothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_name, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words: runs of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 1  # features are runs of 1 to so many words
    least_words: int = 20  # documents with fewer are not drawn
    percent: int = 10  # of the others are drawn
    seed: int = 2024


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def bucket_array(text: Column, how: Resampling) -> Column:
    """The bucket of each feature of a text, repeats included."""
    number = lambda feature: (F.crc32(F.encode(feature, "utf-8")) % how.buckets).cast("int")
    if how.longest == 1:
        return F.transform(_words(text), number)

    def runs(words: Column, n: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: number(F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))

    # An array of one element binds the words, so that they are found once.
    return F.element_at(F.transform(F.array(_words(text)), lambda words: F.concat(*[runs(words, n) for n in range(1, how.longest + 1)])), 1)


def bucket_totals(df: DataFrame, text: str, how: Resampling) -> DataFrame:
    """``bucket, n``: how often each bucket occurs; summed in each task before the shuffle."""
    return df.select(F.explode(bucket_array(F.col(text), how)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, how: Resampling) -> list[int]:
    """The gain of each bucket, in order: 1000 times the log ratio of its smoothed shares in
    the target and in the source, rounded down.  As many values as there are buckets."""
    spark = source.sparkSession
    pair = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(how.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = saved(pair.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = counts.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + how.buckets) / ((s + 1) * (F.col("all_t") + how.buckets))
    rows = counts.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row on the right
    return [r.gain for r in rows.orderBy("bucket").collect()]  # how.buckets rows


def noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from 32 bits of the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(df: DataFrame, table: list[int], how: Resampling, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_words, n_features, weight, score``."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to a literal
    buckets, words = free_name(df, "buckets_of_text"), free_name(df, "words_of_text")
    total, n = F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(values, b + 1)), F.size(buckets).cast("long")
    mean = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.floor(total / n).cast("long"))
    # With single words the array is as long as the text has words.
    count = F.size(buckets) if how.longest == 1 else F.size(_words(F.col(text)))
    out = df.withColumn(buckets, bucket_array(F.col(text), how)).withColumn(words, count)
    added = {"n_words": F.col(words).cast("long"), "n_features": n, "weight": mean}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {"n_words", "n_features", "weight", "score", "rank"}]
    rows = out.select(*keep, *[v.alias(k) for k, v in added.items()])
    return rows.withColumn("score", F.col("weight") + noise(F.col(doc_id), how.seed))


def drawn(rows: DataFrame, how: Resampling, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... by score for those drawn, else null.

    The scores' histogram has at most as many rows as a score has values (the range of the
    gains and of the noise, some 110,000), whatever the input; it gives the lowest score
    that is drawn and how many rows stand before each score.  Rows below are not shuffled,
    and those above are numbered within their score."""
    able = (F.col("n_words") >= how.least_words) & F.col("score").isNotNull()
    levels = saved(rows.where(able).groupBy("score").agg(F.count("*").alias("n")))
    n = levels.agg(F.sum("n")).first()[0] or 0
    wanted = n * how.percent // 100
    before = levels.withColumn("before", F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1))).select(F.col("score").alias("level"), F.coalesce("before", F.lit(0)).alias("before"))
    levels = saved(before.where(F.col("before") < wanted))
    least = levels.agg(F.min("level")).first()[0]
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(able & (F.col("score") >= least), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy(doc_id, "n_features", "weight"))
    top = rows.where(high).withColumn("place", place).join(F.broadcast(levels), F.col("score") == F.col("level"))
    rank = F.col("before") + F.col("place")
    top = top.withColumn("rank", F.when(rank <= wanted, rank)).select(*rows.columns, "rank")
    return top.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_features, weight, score, rank``: its mean gain
    towards ``target``, its noisy score, and its place among the ``percent`` drawn (else
    null).  Columns of these names in ``docs`` are replaced.  Of the others those in
    ``keep`` are written and returned (all, if null; ``doc_id`` must be among them)."""
    table = gains(bucket_totals(docs, text, how), bucket_totals(target, target_text, how), how)
    rows = scored(docs, table, how, doc_id, text)
    if keep is not None:
        rows = rows.select(*keep, "n_words", "n_features", "weight", "score")
    return drawn(saved(rows), how, doc_id)


def resampling_sql(how: Resampling = Resampling()) -> str:
    """The query's rows in SQL (single words); the checksum is spelled out, once per word."""
    return f"""WITH bytes AS (SELECT list(list_reduce([n::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, k: xor(c >> 1, (c & 1) * 3988292384::UBIGINT)) ORDER BY n) AS t FROM range(256) r(n)),
words AS (SELECT doc_id, which, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS w
  FROM (SELECT row_number() OVER () AS doc_id, 's' AS which, text FROM documents UNION ALL SELECT item_id, 't', text FROM benchmark)),
coded AS (SELECT w, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::UBIGINT), lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT]))) % {how.buckets} AS bucket
  FROM (SELECT DISTINCT w FROM words), bytes),
counts AS (SELECT bucket, count(*) FILTER (which = 's') AS s, count(*) FILTER (which = 't') AS t FROM words JOIN coded USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (sum(s) OVER ()::DOUBLE + {how.buckets}) / ((s::DOUBLE + 1) * (sum(t) OVER ()::DOUBLE + {how.buckets}))))::BIGINT AS gain FROM counts),
sums AS (SELECT doc_id AS row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN coded USING (w) JOIN gain USING (bucket) WHERE which = 's' GROUP BY 1),
scores AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{how.seed}:' || d.doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM (SELECT *, row_number() OVER () AS row FROM documents) d LEFT JOIN sums USING (row)),
able AS (SELECT *, n_features >= {how.least_words} AND score IS NOT NULL AS can FROM scores),
ranks AS (SELECT *, CASE WHEN can THEN row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id, n_features, weight) END AS r, count(*) FILTER (can) OVER () AS n FROM able)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {how.percent} // 100 THEN r END AS rank FROM ranks"""
