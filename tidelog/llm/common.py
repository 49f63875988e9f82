"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.session import ship_package

#: Words are runs of anything but ASCII white space; this is what bytes.split() yields.
WORD_BREAK = r"[ \t-\r]+"


def shared_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelog-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


#: Spark's own setting: the files of an execution's shuffles go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written, compressed, to the shared checkpoint folder for as long as the with block lasts."""

    def __init__(self, spark: SparkSession):
        shared_checkpoints(spark)
        self.spark, self.path, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, dictionary: bool = True) -> DataFrame:
        """df computed once, its lineage cut and its shuffles' files removed; hashes are written faster without a dictionary."""
        self.n += 1
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(f"{self.path}/{self.n}")
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def drop(self, df: DataFrame) -> None:
        """Delete a table that cut() returned."""
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where, fs = self._where(at)
            fs.delete(where, True)

    def _where(self, path: str | None = None):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def __exit__(self, *_) -> None:
        where, fs = self._where()
        fs.delete(where, True)


#: What operators keep in a Python worker from task to task.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in this Python worker; it stays until a task of another one that lean() wraps."""
    return _KEPT.setdefault(owner, {})


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's, which returns free memory to the system; without one, nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _lean(run, owner: str, batches):
    others = [k for k in _KEPT if k != owner]
    for k in others:
        _KEPT[k].clear()
    if others:
        _give_back()
    try:
        yield from run(batches)
    finally:
        _give_back()


def lean(run: Callable[[Iterator], Iterator], owner: str) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, in a worker that forgets what other operators keep and gives free memory back afterwards.

    Workers outlive a stage, and what they hold counts with the executor's while a later one needs it.
    """
    return functools.partial(_lean, run, owner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id (bigint) and text, null as empty; extra columns can't clash with an operator's own."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spare(taken: list[str], name: str) -> str:
    """A column name like name that is not taken, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def fold_case(text):
    """Column with A-Z lower-cased and everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
