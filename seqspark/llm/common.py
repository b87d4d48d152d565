"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Python works through text in pieces of about this many bytes, so that its memory doesn't depend on the batch.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a session on one machine names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/seqspark/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def sweep(spark: SparkSession) -> int:
    """Delete what this driver's operators have written to the shared folder so far, and give the number of paths. To be called when
    all results are written: data frames of operators read these files."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def discard(spark: SparkSession, path: str) -> None:
    """Delete what scratch() has named, when nothing will read it again."""
    _MADE.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its rows then outlive lost executors and aren't computed twice."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


_STORES: dict = {}


def keeps(name: str, clear) -> None:
    """Tell how to empty what an operator remembers in a Python worker."""
    _STORES[name] = clear


def only(name: str) -> None:
    """Empty what other operators have left in this worker, and give the memory back: workers are used again, and stores of a whole
    pipeline would add up."""
    if _STORES.get("") == name:
        return
    _STORES[""] = name
    for other, clear in _STORES.items():
        if other not in ("", name):
            clear()
    rest()


def rest() -> None:
    """Give memory back that this worker doesn't use: at the end of a task too, as it may idle through stages without Python."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def pieces(values: list, size: int = PIECE_BYTES):
    """Ranges of consecutive rows that hold about size bytes; a longer row stands alone."""
    at, held = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if held and held + n > size:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(values):
        yield at, len(values)


#: A key is hot that holds more than this share of all rows; there are at most as many hot keys as one through it.
HOT_SHARE, SALTS = 0.001, 64


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The keys of counts (key, n) that hold more than HOT_SHARE of the sum of n: 1,000 at most, so they can be sent around."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return settle(counts.where(F.col(n) > F.lit(max(1.0, HOT_SHARE * total))).select(key), "hot")


def met(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with the narrow table right by key; rows of hot keys stay where they are and right's few rows for them come to them."""
    few = F.broadcast(hot)
    there = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return left.join(few, key, "left_anti").join(right, key, how).unionByName(there)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of (a, b) longs: rows (id, component) for every id of an edge; component is the smallest id.

    Each round every vertex hooks to the neighbour (or itself) of least hash, and edges are rewritten to what their ends
    hooked to; hashes change by round, so paths shrink by a constant factor. Rounds end when no edge between two vertices
    is left. All steps are joins and partial aggregates of narrow rows; each round is a written table.
    """
    now = settle(edges.select("a", "b").where("a <> b").distinct(), tag)
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        mark = lambda c, k=len(rounds): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = settle(
            both.groupBy("a").agg(F.min(mark("b")).alias("m")).select(F.col("a").alias("id"), F.least(F.col("m"), mark("a")).getField("v").alias("to")), tag
        )
        rounds.append(hook)
        one = now.join(hook.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(hook.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        now = settle(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), tag)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    out = rounds[0].select("id", F.col("to").alias("root"))
    for hook in rounds[1:]:
        out = out.join(hook.select(F.col("id").alias("root"), F.col("to").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    out = settle(out, tag)
    least = out.groupBy("root").agg(F.min("id").alias("component"))
    return out.join(least, "root").select("id", "component")
