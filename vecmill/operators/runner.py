"""Evaluation of a catalogue, task by task, by one driver or several.

Every task is a Spark job of its own whose record is written when it is done, so a broken
corpus costs its own tasks only and a run that is stopped goes on where it was.  Several
tasks run at once, each worker in a scheduler pool of its own (pools share the executors
fairly where ``spark.scheduler.mode`` is FAIR), the largest corpora first and the tasks of
one corpus together.

Drivers that share a folder agree by claims: a claim is a file created only where none is,
and its time is its lease.  Its owner renews the time while it works; a claim whose time is
too old may be followed by the next one, which again only one driver can create.  A folder
holds ``tasks/<slug>.json``, ``claims/<slug>.<number>``, ``bags/<corpus>`` and, after
``finalise``, the summary.
"""

from __future__ import annotations

import threading
import time
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks as W
from ..sources import tables as S
from . import metrics as R
from . import summary as Y
from . import training as T
from .evaluate import Encoder, evaluate_beir, evaluate_paired


def tag_of(task: dict) -> str:
    return f"{task['dataset']}/{task['subset']}" + (f"[{task['lang']}]" if task["lang"] else "")


def slug_of(task: dict) -> str:
    return tag_of(task).replace("/", "__").replace("[", "__").replace("]", "")


class Claims:
    """Claims of this driver below a folder."""

    def __init__(self, spark: SparkSession, folder: str, owner: str, lease: float = 600.0):
        self.spark, self.folder, self.owner, self.lease = spark, folder, owner, lease
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        top = self.path(folder)
        self.fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(top)

    def _last(self, name: str) -> int:
        """Number of the last claim of a name, -1 without one."""
        found = [n.rpartition(".")[2] for n, d in S.listing(self.spark, self.folder) if not d and n.rpartition(".")[0] == name]
        return max((int(n) for n in found if n.isdigit()), default=-1)

    def _age(self, name: str, number: int) -> float:
        """Seconds by the store's own clock, read from a file made now."""
        probe = self.path(f"{self.folder}/.clock-{self.owner}-{threading.get_ident()}")
        self.fs.create(probe, True).close()
        now = self.fs.getFileStatus(probe).getModificationTime()
        self.fs.delete(probe, False)
        return (now - self.fs.getFileStatus(self.path(f"{self.folder}/{name}.{number}")).getModificationTime()) / 1000

    def take(self, name: str) -> int | None:
        """Number of the claim if it is ours now, null if another driver holds it."""
        last = self._last(name)
        if last >= 0 and self._age(name, last) < self.lease:
            return None
        try:
            out = self.fs.create(self.path(f"{self.folder}/{name}.{last + 1}"), False)
        except Exception as e:  # another driver was faster
            if "exist" in str(e).lower():
                return None
            raise
        out.write(bytearray(self.owner.encode()))
        out.close()
        return last + 1

    def holds(self, name: str, number: int) -> bool:
        return self._last(name) == number

    def renew(self, name: str, number: int) -> None:
        at = self.path(f"{self.folder}/{name}.{number}")
        self.fs.setTimes(at, int(time.time() * 1000), -1)

    def release(self, name: str, number: int) -> None:
        """After a failure: the next driver need not wait for the lease."""
        self.fs.setTimes(self.path(f"{self.folder}/{name}.{number}"), 0, -1)

    @contextmanager
    def kept(self, name: str, number: int) -> Iterator[None]:
        """Renews the claim's lease until the block ends."""
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(self.lease / 3):
                self.renew(name, number)

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        try:
            yield
        finally:
            stop.set()
            thread.join()


def evaluated(spark: SparkSession, task: dict, encode_pages: Encoder, encode_queries: Encoder, bags_dir: str, ks: tuple[int, ...] = R.KS, **limits) -> DataFrame:
    """One row of metrics of a task.  The pages of a corpus are encoded once, to a table below
    ``bags_dir`` named by the corpus; a finished table is reused."""
    path = f"{bags_dir}/{S.corpus_id(task['fmt'], task['corpus'], limits.get('max_docs') or 0)}"

    def stored(pages: DataFrame) -> DataFrame:
        if not any(n == "_SUCCESS" for n, _ in S.listing(spark, path)):
            encode_pages(pages).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    if task["fmt"] == "paired":
        return evaluate_paired(S.read_rows(spark, task["corpus"]), stored, encode_queries, ks=ks, **limits)
    return evaluate_beir(*(S.read_rows(spark, task[k]) for k in ("corpus", "queries", "qrels")), stored, encode_queries, ks=ks, **limits)


def records_of(spark: SparkSession, folder: str, metrics: list[str] = R.METRICS) -> DataFrame:
    """The task records of a run, those that failed included."""
    schema = "task string, dataset string, subset string, lang string, fmt string, n_queries long, n_docs long, seconds double, eval_protocol string, eval_contract_id string, run_name string, error string, " + ", ".join(f"{m} double" for m in metrics)
    names = [n for n, d in S.listing(spark, f"{folder}/tasks") if not d and n.endswith(".json")]
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json([f"{folder}/tasks/{n}" for n in names]) if names else spark.createDataFrame([], f"{schema}, _corrupt_record string")
    return rows.where("_corrupt_record is null and task is not null").drop("_corrupt_record")


def run_tasks(spark: SparkSession, tasks: list[dict], encode_pages: Encoder, encode_queries: Encoder, folder: str, protocol: str = "", contract_id: str = "", run_name: str = "", workers: int = 4, ks: tuple[int, ...] = R.KS, claims: Claims | None = None, on_done: Callable[[dict], None] | None = None, **limits) -> DataFrame:
    """Evaluate the tasks of a catalogue that have no usable record yet; the records of the
    run, a row for each task that has one, in the catalogue's order.

    A usable record has complete metrics, no error and the same protocol and contract.  A
    task that fails leaves a record with its ``error``, which the next run tries again.  With
    ``claims``, tasks that another driver holds are left to it."""
    metrics = [f"{m}_at_{k}" for m in R.NAMES for k in ks]
    listed = S.catalogue(spark, tasks)
    done = {r.task for r in records_of(spark, folder, metrics).where(R.usable(protocol, contract_id, metrics)).select("task").collect()}  # a row a task
    left = {tag_of(t): t for t in tasks if tag_of(t) not in done}

    def size(paths: list[str]) -> int:
        try:
            return S.corpus_size(spark, paths)
        except Exception:  # the task itself will tell
            return 0

    sizes = {tag: size(t["corpus"]) for tag, t in left.items()}
    shares = T.balanced(sizes, max(1, min(workers, len(left) or 1)), {tag: t["corpus_key"] for tag, t in left.items()})

    def one(task: dict) -> None:
        slug, number = slug_of(task), None
        if claims is not None and (number := claims.take(slug)) is None:
            return
        began = time.perf_counter()
        record = {"task": tag_of(task), **{k: task[k] for k in ("dataset", "subset", "lang", "fmt")}, "eval_protocol": protocol, "eval_contract_id": contract_id, "run_name": run_name}
        with claims.kept(slug, number) if claims is not None else _nothing():
            try:
                row = evaluated(spark, task, encode_pages, encode_queries, f"{folder}/bags", ks, **limits).first()
                record |= {"error": None, **row.asDict()}
            except Exception as e:
                record |= {"error": "".join(traceback.format_exception_only(e)).strip().splitlines()[0][:500]}
        record["seconds"] = round(time.perf_counter() - began, 3)
        if claims is not None and not claims.holds(slug, number):
            return  # the lease ran out and another driver does it
        W.write_json(spark, f"{folder}/tasks/{slug}.json", record)
        if claims is not None and record["error"]:
            claims.release(slug, number)
        if on_done:
            on_done(record)

    broken: list[BaseException] = []

    def work(share: list[str], pool: str) -> None:
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            for tag in share:
                one(left[tag])
        except BaseException as e:  # not the task's but the run's: the records cannot be written
            broken.append(e)

    threads = [InheritableThread(target=work, args=(share, f"tasks-{i}")) for i, share in enumerate(shares) if share]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if broken:
        raise broken[0]
    rows = records_of(spark, folder, metrics)
    return listed.select("place", "task").join(rows, "task").orderBy("place").drop("place")


@contextmanager
def _nothing() -> Iterator[None]:
    yield


def finalise(spark: SparkSession, folder: str, tasks: list[dict], title: str, claims: Claims, protocol: str = "", contract_id: str = "", metrics: list[str] = R.METRICS, wait: float = 0.0, poll: float = 5.0) -> dict | None:
    """Write the summary once every task has a record of this contract, usable or failed;
    null if tasks are missing after ``wait`` seconds or another driver is the one that
    writes.  Every driver may call it."""
    until = time.monotonic() + wait
    listed = S.catalogue(spark, tasks)
    while True:
        rows = records_of(spark, folder, metrics)
        own = rows.where((F.col("eval_protocol") == protocol) & (F.col("eval_contract_id") == contract_id) & (F.col("error").isNotNull() | R.usable(protocol, contract_id, metrics)))
        if R.pending(listed, own).isEmpty():
            break
        if time.monotonic() >= until:
            return None
        time.sleep(poll)
    number = claims.take("summary")
    if number is None:
        return None
    with claims.kept("summary", number):
        return Y.write_summary(spark, folder, own, listed, title, metrics)
