"""What the operators of this subpackage share: saved tables, word columns, hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="folioscan-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


#: Folders of tables that were saved and not deleted yet.
_saved: list[str] = []


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    The table goes with :func:`drop_saved`, at the end of :func:`scratch`, or else when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    _saved.append(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared one."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def drop_saved(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`save` wrote, once what was made of them is saved in turn."""
    for df in tables:
        path = getattr(df, "_saved_path", None)
        if path:
            delete(df.sparkSession, path)
            if path in _saved:
                _saved.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are saved inside are deleted at the end: for steps whose result is written there."""
    first = len(_saved)
    yield
    for path in _saved[first:]:
        delete(spark, path)
    del _saved[first:]


def crc_mod(col: str, mod: int):
    """crc32 of a column as text, modulo ``mod``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


#: Whose tables this worker holds, and what frees them.
_held: tuple[str, Callable[[], None] | None] = ("", None)


def claim(owner: str, free: Callable[[], None] | None = None) -> None:
    """To be called by what runs in a worker: frees the tables that another operator left there.

    Workers serve stage after stage and keep what modules hold, so that vocabularies and word tables are built once;
    without this, those of all stages that ran so far would add up.
    """
    global _held
    before, drop = _held
    if before == owner:
        return
    _held = (owner, free)
    if drop is not None:
        drop()
        rest()


def rest() -> None:
    """To be called where a worker's partition ends: gives back memory that is free, which an idle worker keeps otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, alike in every process."""
    from pandas.util import hash_array

    if not words:
        return np.zeros(0, np.uint64)
    a = np.empty(len(words), dtype=object)
    a[:] = words
    return hash_array(a, categorize=False)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges`` (u, v: long): one row (id, component) per vertex, component the smallest id.

    Each round points every vertex at its smallest neighbour, jumps pointers once and contracts the graph to the
    vertices pointed at, until no edge is left; the number of rounds grows with the logarithm of the diameter.  All
    rounds are joins and sums over saved tables, so hot vertices are split by adaptive execution and nothing but a
    count reaches the driver.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    live = save(both(edges.where("u <> v")).distinct(), tag)
    maps: list[DataFrame] = []
    while live.limit(1).count():
        up = live.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        up = save(up, tag)
        nxt = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = save(up.join(nxt, "p").select("u", F.col("pp").alias("p")), tag)
        drop_saved(up)
        maps.append(jump)
        left = live.join(jump, "u").select("p", "v")
        right = jump.select(F.col("u").alias("v"), F.col("p").alias("q"))
        new = save(left.join(right, "v").where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct(), tag)
        drop_saved(live)
        live = new
    if not maps:
        return live.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = maps[-1]
    for m in reversed(maps[:-1]):  # compose: m maps to the vertices of the next round, or to a finished root
        last = out.select(F.col("u").alias("p"), F.col("p").alias("r"))
        new = save(m.join(last, "p", "left").select("u", F.coalesce("r", "p").alias("p")), tag)
        drop_saved(m, out)
        out = new
    found = out.select(F.col("u").alias("id"), F.col("p").alias("component"))
    found._saved_path = out._saved_path
    return found
