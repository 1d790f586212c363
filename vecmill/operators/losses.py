"""Forward values of contrastive and distillation losses on score tables.

A score table has ``query_id, doc_id, score`` and, where a loss needs them,
``teacher_score``, ``is_pos`` (one row per query), ``slot_mask``, ``group_id`` (of the
document's query) and ``sample_weight``.  A softmax over the candidates of a query (of a
document for the column direction) is a maximum and a sum of exponentials: two partial
aggregates, put beside the candidates where every one is needed (``beside``), so a key
with very many candidates is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

HOT_ROWS = 1_000_000  # rows of a key beyond which they are dealt to several tasks
MASKED = -1e4  # logit of a masked candidate in the distillation losses


def beside(df: DataFrame, totals: DataFrame, keys: list[str], share: int = HOT_ROWS) -> DataFrame:
    """Rows with their key's row of ``totals`` (``key_rows`` among its columns, none of
    which ``df`` has).

    Totals of keys with more than ``share`` rows, at most one in ``share`` rows, are
    broadcast, and these keys' rows are dealt by all their columns; the others meet their
    totals by the key."""
    names = [c for c in totals.columns if c not in keys]
    hot = totals.where(F.col("key_rows") > share).withColumnsRenamed({c: f"hot_{c}" for c in names})
    rows = df.join(F.broadcast(hot), keys, "left")
    dealt = 1 + F.pmod(F.xxhash64(*df.columns), F.ceil(F.col("hot_key_rows") / share))
    rows = rows.withColumn("key_salt", F.when(F.col("hot_key_rows").isNull(), F.lit(0)).otherwise(dealt).cast("int"))
    # A computed 0: a literal would not count as a key of the join.
    cold = totals.where(F.col("key_rows") <= share).withColumn("key_salt", (F.col("key_rows") > share).cast("int"))
    both = rows.join(cold, [*keys, "key_salt"], "left").where("key_rows is not null or hot_key_rows is not null")
    return both.select(*df.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in names])


def softmax_sums(df: DataFrame, keys: list[str], *columns: str, share: int = HOT_ROWS) -> DataFrame:
    """Per key the maximum ``c_peak`` and the sum ``c_sum`` of ``exp(c - c_peak)`` of each
    column, and the number of rows ``key_rows``."""
    peaks = df.groupBy(*keys).agg(*[F.max(c).alias(f"{c}_peak") for c in columns], F.count("*").alias("key_rows"))
    sums = [F.sum(F.exp(F.col(c) - F.col(f"{c}_peak"))).alias(f"{c}_sum") for c in columns]
    firsts = [F.first(c).alias(c) for c in (*[f"{c}_peak" for c in columns], "key_rows")]
    return beside(df.select(*keys, *columns), peaks, keys, share).groupBy(*keys).agg(*firsts, *sums)


def log_softmax(c: str) -> Column:
    """Of a column that is joined with its ``softmax_sums``."""
    return F.col(c) - F.col(f"{c}_peak") - F.log(f"{c}_sum")


def with_positive(df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """The positive row's values of each key, as new columns by name."""
    own = df.where("is_pos").groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in columns.items()])
    return df.join(own, keys, "left")


def filter_high_negatives(df: DataFrame, threshold: float = 0.95, factor: float = 0.5, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Negatives above ``threshold`` times the positive score are scaled by ``factor``."""
    df = with_positive(df, list(keys), pos_score="score")
    hot = ~F.col("is_pos") & (F.col("score") > threshold * F.col("pos_score"))
    return df.withColumn("score", F.when(hot, F.col("score") * factor).otherwise(F.col("score"))).drop("pos_score")


def same_group_mask(df: DataFrame, own: str = "query_group_id", other: str = "doc_group_id", value: float = float("-inf")) -> DataFrame:
    """Documents of the query's own group are no negatives."""
    return df.withColumn("score", F.when((F.col(own) == F.col(other)) & ~F.col("is_pos"), F.lit(value)).otherwise(F.col("score")))


def candidate_masks(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``masked`` for rows of the square of a batch's queries and documents and for slots
    of hard negatives (``is_hard``).

    In the square a pair is masked that is not the query's own target and whose query
    and document are of one group (``query_group_id``, ``doc_group_id``), or whose
    document is a known positive of the query (``known``: ``query_id, doc_id``), which
    covers repeats of the target among the candidates.  A slot of hard negatives is
    masked where it is invalid (``slot_mask``) or holds a known positive.  The same mask
    serves the row and the column direction and the teacher."""
    hard = F.coalesce(F.col("is_hard"), F.lit(False)) if "is_hard" in df.columns else F.lit(False)
    slot = F.coalesce(F.col("slot_mask"), F.lit(1)) <= 0 if "slot_mask" in df.columns else F.lit(False)
    group = F.lit(False)
    if {"query_group_id", "doc_group_id"} <= set(df.columns):
        group = F.coalesce(F.col("query_group_id") == F.col("doc_group_id"), F.lit(False))
    positive = F.lit(False)
    if known is not None:
        k = known.select("query_id", "doc_id").distinct().withColumn("is_known", F.lit(True))
        df = df.join(k, ["query_id", "doc_id"], "left")
        positive = F.coalesce(F.col("is_known"), F.lit(False))
    bad = positive | F.when(hard, slot).otherwise(group)
    return df.withColumn("masked", bad & ~F.col("is_pos")).drop("is_known")


def score_tower(square: DataFrame, query_sizes: DataFrame, negatives: DataFrame | None = None, include_negatives: bool = False, block: Column | None = None) -> dict[str, DataFrame]:
    """Views on one table of scores, as the losses need them, each score divided by its
    query's tokens (``query_id, n_qtok``).

    ``square`` has ``query_id, doc_id, score, is_pos`` of a batch's queries and documents.
    ``rows`` are the pairs of the queries in ``block`` (a condition on ``query_id``; all by
    default), ``cols`` all pairs with those queries' own documents, ``pos`` the targets,
    ``neg`` the scores of hard negatives, and ``kd_rows`` the rows, with ``negatives``
    appended where they are included."""

    def normal(df: DataFrame) -> DataFrame:
        return df.join(query_sizes, "query_id").withColumn("score", F.col("score") / F.col("n_qtok")).drop("n_qtok")

    whole = normal(square)
    rows = whole if block is None else whole.where(block)
    own = rows.where("is_pos").select("doc_id").distinct()
    out = {"pos": rows.where("is_pos"), "rows": rows, "cols": whole.join(own, "doc_id", "left_semi"), "kd_rows": rows}
    if negatives is not None:
        out["neg"] = normal(negatives if block is None else negatives.where(block))
        if include_negatives:
            out["kd_rows"] = rows.unionByName(out["neg"], allowMissingColumns=True)
    return out


def out_of_range(scores: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Normalised scores outside [-1, 1]."""
    return scores.where(F.abs("score") > 1 + tolerance)


def mask_logits(x: Column, masked: Column | None) -> Column:
    return x if masked is None else F.when(masked, F.lit(MASKED)).otherwise(x)


def info_nce(df: DataFrame, temperature: float = 0.02) -> DataFrame:
    """``query_id, loss``: cross entropy of the positive among its candidates."""
    x = df.select("query_id", "is_pos", (F.col("score") / temperature).alias("x"))
    own = x.where("is_pos").join(softmax_sums(x, ["query_id"], "x"), "query_id")
    return own.select("query_id", (-log_softmax("x")).alias("loss"))


def hard_negative_softplus(df: DataFrame, temperature: float = 0.02) -> DataFrame:
    """``query_id, loss``: masked mean of ``softplus((negative - positive) / T)``."""
    df = with_positive(df, ["query_id"], pos_score="score").where(~F.col("is_pos"))
    slot = V.softplus((F.col("score") - F.col("pos_score")) / temperature)
    mask = F.coalesce(F.col("slot_mask"), F.lit(1)).cast("double")
    return df.groupBy("query_id").agg((F.sum(slot * mask) / F.greatest(F.sum(mask), F.lit(1.0))).alias("loss"))


def blended(hard: DataFrame, in_batch: DataFrame, weight: float = 0.5) -> DataFrame:
    """``(1 - weight) * hard + weight * in_batch`` by query."""
    b = in_batch.withColumnRenamed("loss", "__ib")
    return hard.join(b, "query_id").select("query_id", (F.col("loss") * (1 - weight) + F.col("__ib") * weight).alias("loss"))


def weighted_mean(losses: DataFrame, weight: str | None = None) -> DataFrame:
    """One row ``loss``: plain mean, or weighted with the denominator floored at 1e-6."""
    if weight is None:
        return losses.agg(F.avg("loss").alias("loss"))
    return losses.agg((F.sum(F.col(weight) * F.col("loss")) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("loss"))


def listwise_kl(df: DataFrame, temperature: float = 0.02, teacher_temperature: float = 1.0) -> DataFrame:
    """One row ``loss``: KL(softmax(grade / Tt) || softmax(score / T)), mean over queries."""
    x = df.select("query_id", (F.col("score") / temperature).alias("q"), (F.col("grade") / teacher_temperature).alias("p"))
    rows = beside(x, softmax_sums(x, ["query_id"], "p", "q"), ["query_id"])
    kl = F.exp(log_softmax("p")) * (log_softmax("p") - log_softmax("q"))
    return rows.agg((F.sum(kl) / F.countDistinct("query_id")).alias("loss"))


def _distilled(df: DataFrame, key: str, tie: str, temperature: float, teacher_temperature: float, floor: float, wrong: float, masked: Column | None) -> DataFrame:
    """``key, kl, confidence``: teacher and student softmax in one pass."""
    p = mask_logits(F.col("teacher_score") / teacher_temperature, masked)
    q = mask_logits(F.col("score") / temperature, masked) if "score" in df.columns else p
    valid = F.lit(1) if masked is None else (~masked).cast("long")
    x = df.select(F.col(key), F.col(tie), "is_pos", p.alias("p"), q.alias("q"), valid.alias("valid"))
    rows = beside(x, softmax_sums(x, [key], "p", "q"), [key])
    lp, lq = log_softmax("p"), log_softmax("q")
    g = rows.groupBy(key).agg(
        F.sum(F.exp(lp) * (lp - lq)).alias("kl"), (-F.sum(F.exp(lp) * lp)).alias("h"), F.sum("valid").alias("n"),
        F.min_by("is_pos", F.struct(-F.col("p"), F.col(tie))).alias("right"),
    )
    clarity = F.least(F.greatest(1 - F.col("h") / F.log(F.greatest(F.col("n"), F.lit(2))), F.lit(0.0)), F.lit(1.0))
    return g.select(key, "kl", ((floor + (1 - floor) * clarity) * F.when(F.col("right"), 1.0).otherwise(wrong)).alias("confidence"))


def teacher_confidence(df: DataFrame, teacher_temperature: float = 0.13, floor: float = 0.1, wrong: float = 0.25, key: str = "query_id", tie: str = "doc_id", masked: Column | None = None) -> DataFrame:
    """``key, confidence``: floor + (1 - floor) * clamp(1 - entropy / ln n), times ``wrong``
    where the teacher's best candidate (ties: the least id) is not the positive."""
    return _distilled(df, key, tie, teacher_temperature, teacher_temperature, floor, wrong, masked).select(key, "confidence")


def relation_kl(df: DataFrame, key: str = "query_id", tie: str = "doc_id", temperature: float = 0.13, teacher_temperature: float = 0.13, confidence: bool = True, masked: Column | None = None) -> DataFrame:
    """``key, loss``: KL of the student's candidates from the teacher's by row (key the
    query) or column (key the document), weighted by the teacher's confidence."""
    d = _distilled(df, key, tie, temperature, teacher_temperature, 0.1, 0.25, masked)
    return d.select(key, (F.col("kl") * F.col("confidence") if confidence else F.col("kl")).alias("loss"))


def relation_loss(df: DataFrame, column_weight: float = 1.0, temperature: float = 0.13, teacher_temperature: float = 0.13, rows: bool = True, columns: bool = True, confidence: bool = True, masked: Column | None = None) -> DataFrame:
    """``query_id, loss``: row and column terms over the weight of the active directions.
    The column term of a query is that of its positive document.  Masked candidates (see
    ``candidate_masks``) have the same low logit for student and teacher."""
    parts, total = [], (1.0 if rows else 0.0) + (column_weight if columns else 0.0)
    if rows:
        parts.append(relation_kl(df, "query_id", "doc_id", temperature, teacher_temperature, confidence, masked))
    if columns:
        own = df.where("is_pos").select("query_id", "doc_id")
        kl = relation_kl(df, "doc_id", "query_id", temperature, teacher_temperature, confidence, masked)
        parts.append(own.join(kl, "doc_id").select("query_id", (column_weight * F.col("loss")).alias("loss")))
    if not parts:
        return df.select("query_id").distinct().withColumn("loss", F.lit(0.0))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("query_id").agg((F.sum("loss") / total).alias("loss"))


def margin_loss(df: DataFrame, teacher_temperature: float = 0.13) -> DataFrame:
    """``query_id, loss``: smooth-L1 of student and teacher margins, by sigmoid confidence."""
    df = with_positive(df, ["query_id"], pos_score="score", pos_teacher="teacher_score").where(~F.col("is_pos"))
    sm, tm = F.col("pos_score") - F.col("score"), F.col("pos_teacher") - F.col("teacher_score")
    slot = V.smooth_l1(sm, tm) * V.sigmoid(tm / teacher_temperature)
    mask = F.coalesce(F.col("slot_mask"), F.lit(1)).cast("double")
    return df.groupBy("query_id").agg((F.sum(slot * mask) / F.greatest(F.sum(mask), F.lit(1.0))).alias("loss"))


def task_loss(df: DataFrame, temperature: float = 0.02, in_batch: float = 0.5, filtered: bool = True) -> DataFrame:
    """``query_id, loss`` of one head: hard negatives (``is_hard``) blended with in-batch."""
    hard = hard_negative_softplus(df.where("is_pos or is_hard"), temperature)
    if in_batch == 0:
        return hard
    rows = df.where("is_pos or not is_hard")
    return blended(hard, info_nce(filter_high_negatives(rows) if filtered else rows, temperature), in_batch)


def normalized_weights(heads: list[int], supplied: dict[int, float] | None = None) -> dict[int, float]:
    """Non-negative weights (1 where not given) that sum to 1."""
    raw = {d: float((supplied or {}).get(d, 1.0)) for d in heads}
    total = sum(raw.values())
    if min(raw.values()) < 0 or total <= 0:
        raise ValueError(f"head weights must be non-negative with a positive sum: {raw}")
    return {d: w / total for d, w in raw.items()}


def combine_heads(parts: DataFrame, weights: dict[int, float], relation: float = 1.0, margin: float = 0.25, anchor: float = 0.25, scale: float = 1.0) -> DataFrame:
    """From ``head, task, relation, margin`` (and ``anchor``) one row of weighted totals and
    ``total = task + scale * (relation + margin + anchor)`` with their factors."""
    w = F.coalesce(*[F.when(F.col("head") == d, F.lit(x)) for d, x in weights.items()], F.lit(0.0))
    sums = [F.sum(w * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ("task", "relation", "margin")]
    a = F.sum(F.coalesce(F.col("anchor"), F.lit(0.0))) if "anchor" in parts.columns else F.sum(F.lit(0.0))
    row = parts.agg(*sums, a.alias("anchor"))
    return row.withColumn("total", F.col("task") + scale * (relation * F.col("relation") + margin * F.col("margin") + anchor * F.col("anchor")))


def symmetric(df: DataFrame, temperature: float = 0.02) -> DataFrame:
    """One row: mean of the query-to-document and document-to-query losses."""
    back = df.select(F.col("doc_id").alias("query_id"), F.col("query_id").alias("doc_id"), "score", "is_pos")
    own = back.where("is_pos").select("query_id")
    there, back = weighted_mean(info_nce(df, temperature)), weighted_mean(info_nce(back.join(own, "query_id", "left_semi"), temperature))
    return there.unionByName(back).agg(F.avg("loss").alias("loss"))
