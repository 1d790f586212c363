"""Training-table preparation: caps, validity filters, expansions, batches, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def source_filter(df: DataFrame, sources: list[str], every: list[str] | None = None, col: str = "source") -> DataFrame:
    """Rows of the given sources; no filter for an empty list or all sources.  The
    predicate reaches the Parquet scan."""
    return df if not sources or every is not None and set(sources) == set(every) else df.where(F.col(col).isin(sorted(sources)))


def first_n_per_source(df: DataFrame, n: int, order: list[str], col: str = "source") -> DataFrame:
    """The first ``n`` rows of each source; only those leave the ranking (group limit)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(col).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key; rows must have a key."""
    rows = df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} is null")).cast(df.schema[key].dataType)))
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*")


def value_counts(df: DataFrame, col: str = "source") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def task_ids(df: DataFrame, order: str, col: str = "source") -> DataFrame:
    """``task_id`` numbers the sources by first appearance.  Only the distinct sources are
    ordered; they join back (broadcast by Spark's own size rule)."""
    first = df.groupBy(col).agg(F.min(order).alias("__first"))
    ids = first.withColumn("task_id", F.row_number().over(Window.orderBy("__first", col)) - 1).drop("__first")
    return df.join(ids, col)


def valid_hard_negatives(df: DataFrame, least: int, col: str = "negative_doc_ids") -> DataFrame:
    """At least ``max(1, least)`` negatives; null lists do not count."""
    return df.where(F.coalesce(F.size(col) >= max(1, least), F.lit(False)))


def renamed_targets(df: DataFrame) -> DataFrame:
    """``positive_doc_id`` and ``negative_doc_ids`` under their target names, unless there."""
    names = {"positive_doc_id": "pos_target", "negative_doc_ids": "neg_target"}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def layout(columns: list[str]) -> str:
    """Which of the row layouts a table has, from its columns."""
    has = set(columns)
    if {"doc_ids", "grades"} <= has:
        return "listwise"
    if {"sample_weight", "query_group_id"} <= has:
        return "all_positive"
    if "positive_doc_ids" in has:
        return "judged"
    return "corpus" if "pos_target" in has or "positive_doc_id" in has else "inline"


def rows_by_layout(df: DataFrame, negatives: int, epoch: int = 0) -> DataFrame:
    """``query`` and the targets of any layout: ``pos_id, neg_ids`` (with weight and group
    for expanded positives, ``grades`` for listwise rows), or ``pos, negs`` where the rows
    carry the targets themselves.  Judged rows take one positive of their pool by a hash
    of query and epoch; of the negatives the first ones are used."""
    kind = layout(df.columns)
    query = F.col("query") if df.schema["query"].dataType.typeName() != "array" else V.pick(F.col("query"), F.to_json("query"), epoch)
    query = query.alias("query")
    if kind == "listwise":
        return df.select(query, F.get("doc_ids", F.lit(0)).alias("pos_id"), F.slice("doc_ids", 2, negatives).alias("neg_ids"), F.slice("grades", 1, negatives + 1).alias("grades"))
    if kind == "inline":
        neg = next((c for c in ("neg_target", "negatives", "negs") if c in df.columns), None)
        negs = F.slice(neg, 1, negatives) if neg else F.lit(None)
        return df.select(query, F.col(next(c for c in ("image", "pos", "document", "text") if c in df.columns)).alias("pos"), negs.alias("negs"))
    own = next((c for c in ("negative_doc_ids", "neg_target") if c in df.columns), None)
    none = F.array().cast("array<bigint>")
    neg = (F.slice(F.coalesce(F.col(own), none), 1, negatives) if own else none).alias("neg_ids")
    if kind == "judged":
        return df.select(query, V.pick(F.col("positive_doc_ids"), F.col("query"), epoch).alias("pos_id"), neg)
    pos = F.col("positive_doc_id" if "positive_doc_id" in df.columns else "pos_target").alias("pos_id")
    extra = ["sample_weight", "query_group_id"] if kind == "all_positive" else []
    return df.select(query, pos, neg, *extra)


def expand_positives(df: DataFrame, group: Column) -> DataFrame:
    """One row per positive: weight 1 / number of positives, group id of the query."""
    rows = df.withColumn("query_group_id", group).withColumn("sample_weight", 1.0 / F.size("positive_doc_ids"))
    return rows.select("query", F.explode("positive_doc_ids").alias("positive_doc_id"), "negative_doc_ids", "negative_mask", "sample_weight", "query_group_id")


def strict_join(left: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Inner join that fails where a key is missing on the right."""
    c = corpus.withColumn("__hit", F.lit(True))
    joined = left.join(c, key, "left")
    return joined.withColumn("__hit", F.when(F.col("__hit"), True).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))).cast("boolean"))).where("__hit").drop("__hit")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as building a dictionary does."""
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def task_consistent_batches(df: DataFrame, batch: int, seed: int, key: str, task: str = "task_id", shard_rows: int = 100_000, drop_last: bool = True) -> DataFrame:
    """``batch_id``, ``batch_slot`` and ``batch_order``: rows are shuffled within their task (by hash),
    cut into batches of one task, the rest of a task is dropped (or wrapped round from its
    start), and the batches are put in a hashed order.

    Places within a task are counts of earlier hash shards plus a rank inside the shard,
    so a task with most rows is numbered by many tasks of the cluster."""
    h = F.xxhash64(key, F.lit(seed))
    shards = max(1, -(-df.count() // shard_rows))
    rows = df.withColumn("__h", h).withColumn("__shard", F.floor((F.col("__h").cast("double") + 2.0**63) / 2.0**64 * shards).cast("int"))
    sizes = rows.groupBy(task, "__shard").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(task).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__total", F.sum("__n").over(Window.partitionBy(task))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(task, "__shard").orderBy("__h", key)) - 1
    rows = rows.withColumn("__in", inside).join(sizes, [task, "__shard"]).withColumn("__place", F.col("__before") + F.col("__in"))
    whole = F.floor(F.col("__total") / batch) * batch
    if drop_last:
        rows = rows.where(F.col("__place") < whole)
    else:
        need = F.pmod(-F.col("__total"), F.lit(batch))
        times = F.ceil((need - F.col("__place")) / F.col("__total")).cast("int")  # a task shorter than what is missing comes round several times
        again = rows.where(F.col("__place") < need).withColumn("__again", F.explode(F.sequence(F.lit(1), times)))
        rows = rows.unionByName(again.withColumn("__place", F.col("__place") + F.col("__again") * F.col("__total")).drop("__again"))
    rows = rows.withColumn("batch_id", F.floor(F.col("__place") / batch)).withColumn("batch_slot", F.pmod("__place", F.lit(batch)).cast("int")).withColumn("batch_order", F.xxhash64(task, "batch_id", F.lit(seed + 1)))
    return rows.drop("__h", "__shard", "__in", "__before", "__total", "__place")


def rank_batches(df: DataFrame, batch: int, world: int, seed: int, key: str, epoch: int = 0, task: str = "task_id", drop_last: bool = True, shard_rows: int = 100_000) -> DataFrame:
    """Rows of an epoch with ``epoch, rank, batch_no, batch_slot``: global batches of one task
    each, numbered in the epoch's hashed order, of which rank ``r`` of ``world`` has the
    ``r``-th run of ``batch / world`` rows.

    Every epoch shuffles anew, and the same epoch gives the same batches.  Batches are
    numbered as rows are: counts of earlier hash ranges and a rank inside the range."""
    if batch % world:
        raise ValueError(f"a batch of {batch} cannot be dealt to {world} ranks alike")
    rows = task_consistent_batches(df, batch, seed * 1_000_003 + epoch, key, task, shard_rows, drop_last)
    firsts = rows.where("batch_slot = 0").select(task, "batch_id", "batch_order")  # a row a batch
    shards = max(1, -(-df.count() // batch // shard_rows))
    firsts = firsts.withColumn("__shard", F.floor((F.col("batch_order").cast("double") + 2.0**63) / 2.0**64 * shards).cast("int"))
    before = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = firsts.groupBy("__shard").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # a row a shard
    inside = F.row_number().over(Window.partitionBy("__shard").orderBy("batch_order", task, "batch_id")) - 1
    numbers = firsts.withColumn("__in", inside).join(sizes, "__shard").select(F.col(task).alias("__task"), F.col("batch_id").alias("__id"), (F.col("__before") + F.col("__in")).cast("long").alias("batch_no"))
    share = batch // world
    numbered = rows.join(numbers, rows[task].eqNullSafe(F.col("__task")) & (rows["batch_id"] == F.col("__id"))).drop("__task", "__id", "batch_id", "batch_order")
    return numbered.withColumn("epoch", F.lit(epoch)).withColumn("rank", F.floor(F.col("batch_slot") / share).cast("int")).withColumn("batch_slot", F.pmod("batch_slot", F.lit(share)).cast("int"))


def write_rank_batches(df: DataFrame, path: str, batch: int, world: int, seed: int, key: str, epoch: int = 0, files_a_rank: int = 1, **options) -> None:
    """Add an epoch to the batch table: folders by epoch and rank, rows in batch order, each
    file a run of batches, so a rank opens its own files only and skips what it has seen."""
    rows = rank_batches(df, batch, world, seed, key, epoch, **options)
    last = rows.agg(F.max("batch_no")).first()[0]
    run = max(1, -(-((last or 0) + 1) // files_a_rank))
    piece = F.floor(F.col("batch_no") / run).cast("int")
    dealt = rows.withColumn("__piece", piece).repartition(world * files_a_rank, "rank", "__piece").sortWithinPartitions("rank", "__piece", "batch_no", "batch_slot").drop("__piece")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "rank").parquet(path)


def read_rank(df: DataFrame, rank: int, epoch: int, from_batch: int = 0) -> DataFrame:
    """What rank ``rank`` has to do from the cursor (epoch, batch) on, in order: the rest of
    that epoch and all later ones that are there.  Folders of other ranks and earlier epochs
    are not listed, batches before the cursor are skipped by the files' statistics."""
    rest = (F.col("rank") == rank) & (F.col("epoch") >= epoch) & ((F.col("epoch") > epoch) | (F.col("batch_no") >= from_batch))
    return df.where(rest).orderBy("epoch", "batch_no", "batch_slot")


def truncate_to_batches(df: DataFrame, batch: int, order: list[str], col: str = "source") -> DataFrame:
    """Each source cut to a multiple of the batch size, in order (columns that tell the
    rows of a source apart).

    Only a source's last rows are ranked, less than a batch (a group limit before the
    shuffle), so a source with most rows is not numbered by one task."""
    over = df.groupBy(col).agg(F.pmod(F.count("*"), F.lit(batch)).alias("n_over"))
    last = Window.partitionBy(col).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tail = df.select(col, *order).withColumn("from_end", F.row_number().over(last)).where(F.col("from_end") < batch)
    tail = tail.join(over, col).where("from_end <= n_over").select(*[F.col(c).alias(f"tail_{c}") for c in (col, *order)])
    same = [F.col(c).eqNullSafe(F.col(f"tail_{c}")) for c in (col, *order)]
    return df.join(tail, same, "left_anti")


def concatenated(parts: dict[str, DataFrame], batch: int, order: list[str]) -> DataFrame:
    """All datasets, each cut to a multiple of the batch size, with their ``dataset``."""
    rows = None
    for name, part in parts.items():
        own = part.withColumn("dataset", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return truncate_to_batches(rows, batch, order, "dataset")


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but ``keep`` under a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def without_prefix(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the columns with a prefix, under their own names."""
    own = [c for c in df.columns if c.startswith(prefix) and c not in keep]
    return df.select(*keep, *[F.col(c).alias(c[len(prefix) :]) for c in own])


def group_positives(rows: DataFrame, batch: str = "batch_id", group: str = "query_group_id") -> DataFrame:
    """``batch, row_a, row_b`` of different rows (``row_id``) of a batch whose queries are
    of one group: each is a positive of the other.  A batch is small by definition."""
    a = rows.select(batch, group, F.col("row_id").alias("row_a"))
    b = rows.select(batch, group, F.col("row_id").alias("row_b"))
    return a.join(b, [batch, group]).where("row_a <> row_b").select(batch, "row_a", "row_b")


def interleave(sizes: dict[str, int], batch: int, seed: int) -> list[str]:
    """Order of single-dataset batches: the next dataset is drawn by its rows left."""
    import random

    draw, left, out = random.Random(seed), {k: n // batch for k, n in sorted(sizes.items())}, []
    while any(left.values()):
        name = draw.choices(list(left), [n * batch for n in left.values()])[0]
        left[name] -= 1
        out.append(name)
    return out


def seeded_head(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A fixed sample of ``n`` rows in hashed order, taken before any validity filter."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def query_text(text: Column, prefix: str = "", token: str = "", times: int = 10) -> Column:
    """Prompt prefix, text and augmentation tokens; a blank text becomes one space."""
    body = F.when(F.coalesce(V.stripped(text), F.lit("")) == "", F.lit(" ")).otherwise(text)
    return F.concat(F.lit(prefix), body, F.repeat(F.lit(token), times))


def shard_owner(key: Column, shards: int) -> Column:
    """Stable owner of a row among shards."""
    return F.pmod(F.xxhash64(key), F.lit(shards))


def balanced(sizes: dict[str, int], workers: int, corpus: dict[str, str] | None = None) -> list[list[str]]:
    """Largest first to the least loaded worker; tasks of one corpus stay together and
    weigh as much as the largest of them."""
    groups: dict[str, list[str]] = {}
    for name in sizes:
        groups.setdefault((corpus or {}).get(name, f"own {name}"), []).append(name)
    load, out = [0] * workers, [[] for _ in range(workers)]
    for members in sorted(groups.values(), key=lambda g: (-max(sizes[x] for x in g), g[0])):
        i = load.index(min(load))
        load[i] += max(sizes[x] for x in members)
        out[i] += members
    return out


def in_turns(names: list[str], workers: int) -> list[list[str]]:
    """Names dealt to the workers one by one."""
    return [names[i::workers] for i in range(workers)]
