"""Readers for evaluation and training tables, with their schema rules."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is folder) of a folder's entries, sorted, through Hadoop's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(hadoop))


def test_files(spark: SparkSession, path: str) -> list[str]:
    """The ``test-*`` Parquet files of a folder, in order."""
    return [f"{path}/{n}" for n, _ in listing(spark, path) if n.startswith("test-") and n.endswith(".parquet")]


def split_files(spark: SparkSession, path: str) -> list[str]:
    """Parquet files of a folder: the ``test-*`` ones if there are any, else all."""
    return test_files(spark, path) or [f"{path}/{n}" for n, _ in listing(spark, path) if n.endswith(".parquet")]


def _place_of(uri: str) -> str:
    """A file's address without the spelling of its URI (encoded letters, slashes)."""
    parts = urlsplit(uri)
    return f"{parts.scheme}|{parts.netloc}|{unquote(parts.path)}"


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()


def read_rows(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files with ``ord``, their number in the order of the files.

    A row's place in its file comes from the scan and the files' first numbers from a
    count, so nothing is sorted.  Of ``columns`` those that exist are read.  A file that is
    named twice, or one that the scan finds and that was not named, is an error."""
    df = spark.read.parquet(*paths)
    sizes = {r.file: r.n for r in df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()}  # a row per file
    found, places = {_place_of(f): f for f in sizes}, [_place_of(_qualified(spark, p)) for p in paths]
    if len(set(places)) < len(places):
        raise ValueError("a file is named twice")
    if strange := sorted(set(found) - set(places)):
        raise ValueError(f"rows of files that were not named, such as {strange[0]}")
    first, at = [], 0
    for place in places:
        if place in found:  # a file without rows is not
            first.append((found[place], at))
            at += sizes[found[place]]
    starts = F.broadcast(spark.createDataFrame(first, "own_file string, first long"))  # as many rows as files were listed
    keep = [c for c in df.columns if columns is None or c in columns]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col("_metadata.file_path").alias("own_file"), F.col("_metadata.row_index").alias("own_row"))
    return rows.join(starts, "own_file").select(*[F.col(f"`{c}`") for c in keep], (F.col("first") + F.col("own_row")).alias("ord"))


def corpus_size(spark: SparkSession, paths: list[str]) -> int:
    """Number of rows, from the footers (no column is read)."""
    return spark.read.parquet(*paths).count() if paths else 0


#: Folders of datasets in their order (fixed values of the layout).
DATASETS = ("eval", "eval_v2", "eval_v3", "JinaVDR", "demo")


def discover_tasks(spark: SparkSession, root: str, datasets: tuple[str, ...] = DATASETS) -> list[dict]:
    """Catalogue of the known datasets below a folder, in their order.

    A subset is one of: judged triples by language, which all share one corpus (the
    English one, else the first) and need both queries and judgements; judged triples
    without a language, whose judgements may lie in ``docs``; a paired set in ``data``;
    paired sets by language.  Paired sets consist of ``test-*`` files only."""
    tasks = []
    for dataset in datasets:
        for subset, is_dir in listing(spark, f"{root}/{dataset}"):
            if not is_dir:
                continue
            base = f"{root}/{dataset}/{subset}"
            folders = {n for n, d in listing(spark, base) if d}
            common = {"dataset": dataset, "subset": subset}
            corpora = sorted(n for n in folders if n.endswith("-corpus"))
            if corpora:
                shared = "english-corpus" if "english-corpus" in corpora else corpora[0]
                files = split_files(spark, f"{base}/{shared}")
                for lang in (n.removesuffix("-corpus") for n in corpora):
                    if {f"{lang}-queries", f"{lang}-qrels"} <= folders:
                        tasks.append(common | {"fmt": "beir", "lang": lang, "corpus_key": f"{base}/{shared}", "corpus": files, "queries": split_files(spark, f"{base}/{lang}-queries"), "qrels": split_files(spark, f"{base}/{lang}-qrels")})
            elif "corpus" in folders:
                judged = split_files(spark, f"{base}/qrels") or split_files(spark, f"{base}/docs")
                tasks.append(common | {"fmt": "beir", "lang": None, "corpus_key": f"{base}/corpus", "corpus": split_files(spark, f"{base}/corpus"), "queries": split_files(spark, f"{base}/queries"), "qrels": judged})
            elif files := test_files(spark, f"{base}/data"):
                tasks.append(common | {"fmt": "paired", "lang": None, "corpus_key": f"{base}/data", "corpus": files})
            else:
                for lang in sorted(n for n in folders if not n.startswith(".")):
                    if files := test_files(spark, f"{base}/{lang}"):
                        tasks.append(common | {"fmt": "paired", "lang": lang, "corpus_key": f"{base}/{lang}", "corpus": files})
    return tasks


def catalogue(spark: SparkSession, tasks: list[dict]) -> DataFrame:
    """The catalogue as a table, ``place`` its order."""
    rows = [(i, t["dataset"], t["subset"], t["fmt"], t["lang"], t["corpus_key"], t["corpus"], t.get("queries"), t.get("qrels")) for i, t in enumerate(tasks)]
    table = spark.createDataFrame(rows, "place int, dataset string, subset string, fmt string, lang string, corpus_key string, corpus array<string>, queries array<string>, qrels array<string>")
    return table.withColumn("task", task_tag(F.col("dataset"), F.col("subset"), F.col("lang")))


def select_datasets(tasks: list[dict], wanted: str | None = None) -> list[dict]:
    """Tasks of a comma-separated list of datasets; without one all but ``demo``."""
    if wanted:
        names = {x.strip() for x in wanted.split(",") if x.strip()}
        return [t for t in tasks if t["dataset"] in names]
    return [t for t in tasks if t["dataset"] != "demo"]


def task_tag(dataset: Column, subset: Column, lang: Column) -> Column:
    """``dataset/subset[lang]``; no bracket without a language."""
    return F.concat(dataset, F.lit("/"), subset, F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("["), lang, F.lit("]"))).otherwise(""))


def task_slug(tag: Column) -> Column:
    """A tag as a file name."""
    return F.replace(F.replace(F.replace(tag, F.lit("/"), F.lit("__")), F.lit("["), F.lit("__")), F.lit("]"), F.lit(""))


def corpus_id(fmt: str, paths: list[str], max_docs: int = 0) -> str:
    """Name of a corpus by its format, files and limit."""
    return hashlib.sha1(f"{fmt}|{chr(0).join(paths)}|max_docs={int(max_docs)}".encode()).hexdigest()[:16]


def first_column(df: DataFrame, *names: str) -> Column | None:
    """The first of the columns that exists."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), None)


def first_value(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first value that is not null among the columns that exist."""
    found = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*found, *([default] if default is not None else []), F.lit(None).cast("string"))


def _place(df: DataFrame, letter: str) -> Column:
    """A name by the row's number; a table without numbers must have ids."""
    if "ord" in df.columns:
        return F.concat(F.lit(letter), F.col("ord").cast("string"))
    return F.raise_error(F.lit("a row has no id and no number (see read_rows)")).cast("string")


def beir_corpus(df: DataFrame) -> DataFrame:
    """``doc_id`` (``corpus-id``, else ``id``, else ``c`` and the row's number ``ord``) and
    the other columns."""
    rest = [c for c in df.columns if c not in ("corpus-id", "id", "doc_id")]
    return df.select(first_value(df, "corpus-id", "id", default=_place(df, "c")).alias("doc_id"), *[F.col(f"`{c}`") for c in rest])


def duplicate_ids(corpus: DataFrame) -> DataFrame:
    """Document ids that occur more than once (an error for a corpus)."""
    return corpus.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


def beir_queries(df: DataFrame) -> DataFrame:
    """``query_id, text`` (and ``ord``) by the columns that exist; a null text is the word None."""
    key = first_column(df, "id", "query-id")
    key = _place(df, "q") if key is None else key.cast("string")
    text = first_column(df, "text", "query")
    order = ["ord"] if "ord" in df.columns else []
    return df.select(key.alias("query_id"), F.coalesce(text.cast("string") if text is not None else F.lit(None), F.lit("None")).alias("text"), *order)


def beir_qrels(df: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` (and ``ord``); without a score column every pair counts."""
    score = F.col("score").cast("double") if "score" in df.columns else F.lit(None).cast("double")
    order = ["ord"] if "ord" in df.columns else []
    return df.select(first_column(df, "query-id", "id").cast("string").alias("query_id"), first_column(df, "corpus-id", "id").cast("string").alias("doc_id"), score.alias("score"), *order)


def usable_text(text: Column) -> Column:
    """Judged queries: not blank, and unstripped not the word none."""
    return F.coalesce((V.stripped(text) != "") & (F.lower(text) != "none"), F.lit(False))


def keep_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with a usable text and a positive judgement."""
    return queries.where(usable_text(F.col("text"))).join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def paired_queries(df: DataFrame, text: str = "query", page: str = "image_filename") -> DataFrame:
    """Rows with a query: stripped, neither empty nor the word none; the stripped text stays."""
    missing = [c for c in (text, page) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    q = V.stripped(F.col(text))
    return df.withColumn(text, q).where(F.coalesce((q != "") & (F.lower(q) != "none"), F.lit(False)))


def candidate_pages(rows: DataFrame, page: str = "image_filename", max_docs: int | None = None) -> DataFrame:
    """``doc_id`` and the other columns of the first row (by ``ord``) of each page; rows
    whose query is empty count too, a row without a page name is an error."""
    name = F.coalesce(F.col(page).cast("string"), F.raise_error(F.lit(f"{page} is null")).cast("string"))
    return head(first_rows(rows.withColumn("doc_id", name), "doc_id", "ord"), max_docs)


def first_rows(df: DataFrame, key: str, order: str, bound: int = 1_000_000) -> DataFrame:
    """The row of each key that is first in ``order``, a number that tells all rows apart.

    Only these two columns are read and shuffled to choose the rows; the others are read
    afterwards, of the rows that were chosen.  While these, or those left out, are at most
    ``bound`` numbers, they are broadcast and no other column is shuffled at all."""
    chosen = df.groupBy(key).agg(F.min(order).alias("own_first")).select("own_first")
    rows, n = df.select(order).count(), chosen.count()
    same = F.col(f"`{order}`") == F.col("own_first")
    if n <= bound:
        return df.join(F.broadcast(chosen), same, "left_semi")
    if rows - n <= bound:
        others = df.select(order).join(chosen, same, "left_anti").select(F.col(order).alias("own_first"))
        return df.join(F.broadcast(others), same, "left_anti")
    return df.join(chosen, same, "left_semi")


def paired_judged(rows: DataFrame, pages: DataFrame, text: str = "query", page: str = "image_filename", max_queries: int | None = None) -> DataFrame:
    """``query_id, text, doc_id, ord`` of the rows with a query whose page is a candidate;
    others are dropped.  Only the two named columns are read for it."""
    own = paired_queries(rows, text, page).select(F.concat(F.lit("q"), F.col("ord").cast("string")).alias("query_id"), F.col(text).alias("text"), F.col(page).cast("string").alias("doc_id"), "ord")
    return head(own.join(pages.select("doc_id"), "doc_id"), max_queries).select("query_id", "text", "doc_id", "ord")


def head(df: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first ``n`` rows in order (a top-n, not a sort); all of them for null or 0."""
    return df.orderBy(order).limit(n) if n else df


def take(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def image_bytes(df: DataFrame, col: str = "image") -> DataFrame:
    """The image column as binary, be it binary or a struct with ``bytes``; decoding is
    left to where the pixels are needed."""
    kind = df.schema[col].dataType
    if kind.typeName() == "binary":
        return df
    if kind.typeName() == "struct" and "bytes" in kind.fieldNames():
        return df.withColumn(col, F.col(f"{col}.bytes"))
    raise TypeError(f"an image cannot be read from {kind.simpleString()}")


def image_size(image: Column) -> Column:
    """``width, height`` from the header of a PNG or a GIF, null for anything else."""
    number = lambda at, n: F.conv(F.hex(F.substring(image, at, n)), 16, 10).cast("int")
    little = lambda at: number(at + 1, 1) * 256 + number(at, 1)
    png = F.struct(number(17, 4).alias("width"), number(21, 4).alias("height"))
    gif = F.struct(little(7).alias("width"), little(9).alias("height"))
    return F.when(F.hex(F.substring(image, 1, 8)) == "89504E470D0A1A0A", png).when(F.hex(F.substring(image, 1, 4)) == "47494638", gif)


def hard_negatives(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Hard-negative rows under their target names, filtered at the scan."""
    from ..operators.training import renamed_targets, source_filter

    return renamed_targets(source_filter(spark.read.parquet(path), sources or []))


def materialised_parts(spark: SparkSession, root: str, cache: str) -> DataFrame:
    """An export's parts as one table below ``cache``, written once per fingerprint."""
    parts = export_parts(spark, root)
    path = f"{cache}/{file_fingerprint(parts)}"
    if not listing(spark, path):
        parts.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def packed_tokens(dump: DataFrame) -> DataFrame:
    """``doc_id, tokens`` of packed rows ``ids, packed, offsets``: the tokens of all
    documents one after the other, and where each begins."""
    places = F.arrays_zip(F.col("ids"), F.slice("offsets", 1, F.size("ids")).alias("lo"), F.slice("offsets", 2, F.size("ids")).alias("hi"))
    rows = dump.select("packed", F.explode(places).alias("p"))
    return rows.select(F.col("p.ids").alias("doc_id"), F.slice("packed", (F.col("p.lo") + 1).cast("int"), (F.col("p.hi") - F.col("p.lo")).cast("int")).alias("tokens"))


def parameters(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``arm, param, idx, value`` of the weights tables of several arms."""
    rows = None
    for arm, path in paths.items():
        part = spark.read.parquet(path).select(F.lit(arm).alias("arm"), "param", "idx", F.col("value").cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def export_parts(spark: SparkSession, root: str) -> DataFrame:
    """The ``part_*.parquet`` files of an export; an error without any."""
    names = [n for n, d in listing(spark, root) if n.startswith("part_") and n.endswith(".parquet")]
    if not names:
        raise FileNotFoundError(f"no part_*.parquet in {root}")
    return spark.read.parquet(*[f"{root}/{n}" for n in names])


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def file_fingerprint(df: DataFrame) -> str:
    """Digest of names, sizes and times of the files below a table."""
    rows = df.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").distinct().orderBy("file_name").collect()
    return hashlib.sha1("\n".join(f"{r[0]}|{r[1]}|{r[2]}" for r in rows).encode()).hexdigest()


def file_identity(spark: SparkSession, paths: list[str], always: tuple[str, ...] = ("adapter_model.safetensors",), largest: int = 16 << 20) -> DataFrame:
    """``path, size, modified, sha256`` of files; the content is read only of files up to
    ``largest`` bytes and of those named in ``always``, else ``sha256`` is null."""
    rows = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = F.element_at(F.split("path", "/"), -1).isin(*always)
    read = [r.path for r in rows.where((F.col("size") <= largest) | named).select("path").collect()]  # as many as files were listed
    if not read:
        return rows.withColumn("sha256", F.lit(None).cast("string"))
    digests = spark.read.format("binaryFile").load(read).select("path", F.sha2("content", 256).alias("sha256"))
    return rows.join(digests, "path", "left")


def contract(fields: dict) -> str:
    """Digest of settings in canonical JSON."""
    return hashlib.sha256(json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def evaluation_contract(spark: SparkSession, protocol: str, run_name: str, training: dict, evaluation: dict, model_files: list[str], tasks: list[dict]) -> str:
    """Digest of all that a cached result depends on: the model's and the data's files,
    the training's and the evaluation's settings, and the tasks in order."""
    data = sorted({f for t in tasks for k in ("corpus", "queries", "qrels") for f in t.get(k) or []})
    told = lambda files, **o: [[r.path, r.size, str(r.modified), r.sha256] for r in file_identity(spark, files, **o).orderBy("path").collect()] if files else []
    tags = [f"{t['dataset']}/{t['subset']}" + (f"[{t['lang']}]" if t["lang"] else "") for t in tasks]
    return contract({"protocol": protocol, "run_name": run_name, "training": training, "evaluation": evaluation, "model_files": told(model_files), "data_files": told(data, largest=-1), "tasks": tags})


def resolve_contract(wanted: dict, trained: dict, head: int, heads: list[int]) -> dict:
    """Settings of an evaluation from those of the training; a mismatch is an error."""
    if head not in heads:
        raise ValueError(f"head {head} is not among the trained {heads}")
    differ = {k: (v, trained[k]) for k, v in wanted.items() if v is not None and k in trained and trained[k] != v}
    if differ:
        raise ValueError(f"settings differ from the training's: {differ}")
    return trained | {k: v for k, v in wanted.items() if v is not None} | {"head": head}


def run_metadata(per_device: int | None, accumulation: int | None, world: int | None, steps: int | None) -> dict:
    """Effective batch and consumed samples; null where a factor is unknown."""
    known = None not in (per_device, accumulation, world)
    batch = per_device * accumulation * world if known else None
    return {"per_device": per_device, "accumulation": accumulation, "world": world, "steps": steps, "effective_batch": batch, "consumed": steps * batch if steps is not None and batch is not None else None}


def default_paths(spark: SparkSession, name: str) -> dict[str, str]:
    """Where a run's caches and task records lie, below the warehouse."""
    top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
    return {"datasets": f"{top}/datasets", "tasks": f"{top}/tasks", "dumps": f"{top}/dumps", "indexes": f"{top}/indexes"}


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON object; missing, broken or other than an object gives an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    rows = spark.read.text(path, wholetext=True).head(1)
    try:
        found = json.loads(rows[0].value) if rows else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def parse_dims(spec: str) -> tuple[int, ...]:
    """Distinct positive widths of a comma-separated list, ascending."""
    try:
        dims = tuple(sorted({int(x) for x in spec.split(",") if x.strip()}))
    except ValueError:
        raise ValueError(f"not a list of widths: {spec!r}") from None
    if dims and dims[0] <= 0 or spec.strip() and not dims:
        raise ValueError(f"widths must be positive: {spec!r}")
    return dims


def parse_dim_map(spec: str, allowed: tuple[int, ...]) -> dict[int, float]:
    """``width:value`` pairs of a comma-separated list; unknown widths are an error."""
    out = {}
    for item in (x.strip() for x in spec.split(",")):
        if not item:
            continue
        dim, colon, value = item.partition(":")
        try:
            out[int(dim)] = float(value)
        except ValueError:
            raise ValueError(f"not a width and a value: {item!r}") from None
    if extra := sorted(set(out) - set(allowed)):
        raise ValueError(f"widths {extra} are not among {allowed}")
    return out


def task_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records of finished tasks; what does not parse is skipped."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in df.columns else df


def cached_tasks(spark: SparkSession, path: str, protocol: str, contract_id: str, metrics: list[str]) -> DataFrame:
    """Records that may stand for finished tasks: no error, complete metrics, the same
    protocol and contract."""
    from ..operators.metrics import usable

    df = task_records(spark, path)
    for c, kind in [("error", "string"), ("eval_protocol", "string"), ("eval_contract_id", "string"), *((m, "double") for m in metrics)]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.where(usable(protocol, contract_id, metrics))


def image_tokens(dump: DataFrame) -> DataFrame:
    """Image span of each document's tokens."""
    return dump.select("doc_id", F.slice("tokens", F.col("image_start") + 1, F.col("image_end") - F.col("image_start")).alias("tokens"), "grid_thw")
