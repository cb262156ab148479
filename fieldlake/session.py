"""Session set-up, lineage cutting and size checks."""

from __future__ import annotations

import contextvars
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
AT_ONCE = 3
AT_ONCE_ROWS = 1_000_000  # of tables with more rows the tasks fill the cluster anyway, and one intermediate at a time lies on disk

_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def build_session(app_name: str = "fieldlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Shuffle partition counts are left to the caller or the cluster; adaptive
    execution merges small partitions and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="fieldlake-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _local_dir()


def cut_lineage(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write to the shared folder and read back. Inside :func:`short_lived` the files last as long as that; ``outer`` ones outlast the innermost.

    Ends the lineage in files that survive losing executors, and gives later
    plans real sizes and column pruning, which an RDD checkpoint would not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fieldlake-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Files of :func:`cut_lineage` that are written inside go when it ends, and shuffles that nothing refers to any more.

    Nothing made of them may be left to be worked out later: collect results, or write them with ``outer``.
    """
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if paths:
            gc.collect()  # lets go of the plans on the other side, whose shuffles Spark then removes
            spark._jvm.System.gc()


def at_once[T](spark: SparkSession, works: list[Callable[[], T]], rows: int = 0) -> list[T]:
    """What the works return, in their order; up to AT_ONCE of them run side by side, or one where they work on many ``rows``.

    For works that do not need each other and are made of many small jobs, so that one plans while another's tasks run.
    """
    with ThreadPoolExecutor(min(len(works), AT_ONCE if rows <= AT_ONCE_ROWS else 1) or 1) as pool:
        return [f.result() for f in [pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(w)) for w in works]]


def at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has no more than ``limit`` rows; reads at most ``limit + 1``."""
    return df.limit(limit + 1).count() <= limit


def may_broadcast(df: DataFrame) -> bool:
    """True when ``df`` is small enough for every executor: at most BROADCAST_ROWS rows and, as text, BROADCAST_BYTES."""
    size = F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a table of any length for joins that shuffle both sides, whatever its size is thought to be.

    Spark takes the size of a written table from its files. Keys and lists of a few values are packed there to a small
    part of what the rows take in memory, and rows exploded from the lists do not count: a table of millions of keys
    would look small enough to go through the driver to every executor.
    """
    return df.hint("merge")


def salted(df: DataFrame, salts: int, *by: str, name: str = "_salt") -> DataFrame:
    """Add a deterministic salt taken from the row's own values (safe under task retry)."""
    columns = [F.col(f"`{c}`") for c in (by or df.columns)]
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """Copy each row once per salt, to meet the rows of :func:`salted`."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    A hot key is spread over ``salts`` tasks; ``small`` is copied to each.
    ``how`` must keep the ``big`` side (inner, left, left_semi, left_anti).
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salted_join cannot do {how!r}")
    if salts <= 1:
        return big.join(small, on, how)
    joined = salted(big, salts).join(replicated(small, salts), [*on, "_salt"], how)
    return joined.drop("_salt")
