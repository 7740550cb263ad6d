"""Helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one model at a time, as workers outlive queries."""
    here = sys.modules.setdefault("_weftgraph_worker", types.ModuleType("_weftgraph_worker")).__dict__
    if here.get("key") != key:
        here["key"] = here["value"] = None  # the old one goes before the new one is made
        here["value"], here["key"] = make(), key
    return here["value"]


#: Bytes of a batch that a Python worker gets at most, but for a longer text.
BATCH_BYTES = 8 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts go to Python workers in small batches from now on.

    A batch of Spark's usual 10,000 rows holds whole partitions of texts, in
    the JVM's buffers, in Arrow and as strings.  The setting is the session's;
    a lower one stays.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key)) or 1 << 31) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def hand_back() -> None:
    """Give memory that a worker has freed back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Share of the driver's heap that may be taken up before :func:`tidy` collects what is free.
GROWN = 1 / 3


def trim_native(spark: SparkSession) -> str:
    """Ask the driver's JVM to give back native memory it has freed; returns what it says."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # the server's own class is closed to reflection, its interface is open
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = array(jvm.java.lang.Object, 4)
    args[0], args[1] = name, "systemTrimNativeHeap"
    return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def tidy(spark: SparkSession, collect: bool = False) -> None:
    """Free what the driver no longer needs, and hand it back to the machine.

    Relations and blocks of broadcasts, shuffles and checkpoints stay until the
    JVM happens to collect them, which it does only after its heap has grown to
    the bound; the native buffers beside it stay with the allocator.  ``collect`` has it
    collect in any case, so that files that are no longer needed go.
    """
    gc.collect()  # else the JVM's objects are held from here
    hand_back()
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if collect or heap.totalMemory() > heap.maxMemory() * GROWN:
        jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # not every JVM has the command
        trim_native(spark)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that every executor can read again.

    The folder is the one set on the context, or the session's
    ``spark.checkpoint.dir``.  A machine of one's own (master ``local``) that
    names neither gets a temporary one; on a cluster that is an error, as
    executors would not find each other's files.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    tidy(spark)
    return out


def shared_folder(spark: SparkSession) -> str:
    """Where what the executors share may be written; see :func:`settle`."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="weft-")


#: Rows up to which a lookup table is broadcast (some 100 bytes each; what holds arrays counts as more).
BROADCAST_ROWS = 100_000
#: Copies of a larger lookup table, so that rows of one hot key spread over as many tasks.
SALTS = 32


#: A value may stand in one row of so many before its rows are joined apart.
HOT = 1000


def numbered(df: DataFrame, times: str, at: str, step: int = 10_000) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``at``; a row that repeats very often is no one long array."""
    some = fresh(df, "some")
    span = lambda lo, hi: F.explode(F.sequence(lo, hi - 1))
    df = df.withColumn(some, span(F.lit(0).cast("long"), F.ceil(F.col(times) / step)))
    return df.withColumn(at, span(F.col(some) * step, F.least(F.col(times), (F.col(some) + 1) * step))).drop(some, times)


def join_counted(rows: DataFrame, dim: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Left join of ``rows``, ``total`` in number, to a table that is unique by ``key`` and tells in ``copies`` how many of them have it.

    Fewer than ``HOT`` values can stand in more than one row of ``HOT``: those
    are broadcast, the others shuffled.  ``key`` is not null in ``rows``.
    """
    hot = dim.filter(F.col(copies) > total // HOT).drop(copies)
    cool = dim.filter(F.col(copies) <= total // HOT).drop(copies)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def lookup(rows: DataFrame, dim: DataFrame, key: str, spread: Column, how: str = "inner", weight: Column | None = None) -> DataFrame:
    """Join ``rows`` to a table that is unique by ``key``, whatever the skew of ``rows``.

    ``dim`` is counted: a small one is broadcast, a large one is copied under
    ``SALTS`` salts and ``rows`` pick one by ``spread``, an integer expression.
    A row of ``dim`` counts as ``weight`` rows, one if none is given.
    """
    some = dim.limit(BROADCAST_ROWS + 1)
    if (some.count() if weight is None else some.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(dim), key, how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")
