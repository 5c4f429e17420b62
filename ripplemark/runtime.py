"""Session helpers: the session itself, staged tables in the cluster's shared folder, bounded collects."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN_DIRS: list[str] = []
_STAGED: list[str] = []


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ripplemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves, but only if driver and executors are one machine's processes.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ripplemark-")
        _OWN_DIRS.append(named)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


class Staged:
    """A DataFrame written to the shared folder: its lineage is cut and any executor can read it again.

    metrics: aggregates by name that are taken while the rows are written; they are in `seen` then. by: columns of few
    values, by which the files are laid out, so that a filter on them reads only what it asks for."""

    def __init__(self, df: DataFrame, tag: str = "stage", metrics: dict[str, Column] | None = None, by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        watch = Observation(f"{tag}-{uuid.uuid4().hex}") if metrics else None
        if watch is not None:
            df = df.observe(watch, *[c.alias(n) for n, c in metrics.items()])
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        _STAGED.append(self.path)
        df.write.partitionBy(*by).parquet(self.path)
        self.seen = watch.get if watch is not None else {}
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        with contextlib.suppress(Exception):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def _sweep() -> None:
    for d in [*_STAGED, *_OWN_DIRS]:
        if d.startswith(("file:", "/")):
            shutil.rmtree(d.removeprefix("file:"), ignore_errors=True)
    spark = SparkSession.getActiveSession() if _STAGED else None
    if spark is not None:
        for d in _STAGED:
            with contextlib.suppress(Exception):
                p = spark._jvm.org.apache.hadoop.fs.Path(d)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bench_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def held(key: tuple, make):
    """What make() gives, made once in a Python process: functions that travel with tasks bring their own globals along, so
    what is dear to build is kept with the interpreter instead."""
    import sys

    kept = sys.__dict__.setdefault("_ripplemark_held", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def held_last(name: str, key, make):
    """What make() gives, kept in this Python process until the same name is asked for with another key."""
    import sys

    kept = sys.__dict__.setdefault("_ripplemark_held", {})
    if name not in kept or kept[name][0] != key:
        kept.pop(name, None)
        kept[name] = key, make()
    return kept[name][1]
