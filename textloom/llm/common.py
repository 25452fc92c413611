"""What the operators share: reading, storing between jobs, small expressions, blocks of pairs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Characters of text that a task works on together.
PORTION = 1 << 19
#: Rows of texts or vectors that a Python worker gets at once, at most.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batches of rows for Python to ``BATCH_ROWS``: a text may have a hundred thousand characters."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where driver and executors are one process, as in
    tests, may it be unset: then it is a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_dir(spark)
    return path.rstrip("/")


_OWN: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir: unset; tables between jobs need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


#: Tables written by ``stored`` that still stand, by path, and frames that ``kept`` holds on the executors' disks.
_STANDING: dict[str, SparkSession] = {}
_HELD: list[DataFrame] = []


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost executor
    costs no more than a read, and later plans know its size. The table goes with ``scratch``, ``drop_stored`` or the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}"
    if not _STANDING:
        atexit.register(drop_stored)
    _STANDING[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(before: frozenset[str] = frozenset(), held: int = 0) -> None:
    """Remove all tables that ``stored`` has written, but those named, and give back what ``kept`` holds, but the first ``held``. Frames
    that read the tables cannot be read any more."""
    while len(_HELD) > held:
        _release(_HELD.pop())
    for path in [p for p in _STANDING if p not in before]:
        _forget(_STANDING.pop(path), path)


@contextmanager
def scratch(keep: int = 0) -> Iterator[None]:
    """Tables stored inside go when the block ends, also on failure; all but the last ``keep`` of them where it ends well. What is
    wanted afterwards has to be written inside, as the last."""
    before, held, keeps = frozenset(_STANDING), len(_HELD), 0
    try:
        yield
        keeps = keep
    finally:
        new = [p for p in _STANDING if p not in before]
        drop_stored(before | frozenset(new[len(new) - keeps :]), held)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``, whatever the case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def kept(df: DataFrame) -> DataFrame:
    """``df`` for several uses in one operator, on the executors' disks. What a lost executor held is computed again; nothing
    is written to the shared folder, so use it where lineage is short. It is given back with ``scratch`` or ``drop_stored``, after which frames
    that read it compute it again."""
    _HELD.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def _release(df: DataFrame) -> None:
    try:
        df.unpersist()
    except Exception:  # noqa: BLE001  the session has ended already
        return


def _forget(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


def portions(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Row numbers and texts, about ``PORTION`` characters together; a longer text is a portion of its own."""
    rows, texts, n = [], [], 0
    for k, t in enumerate(b["text"]):
        rows.append(k)
        texts.append(t or "")
        n += len(texts[-1])
        if n >= PORTION:
            yield np.array(rows), texts
            rows, texts, n = [], [], 0
    if rows:
        yield np.array(rows), texts


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def told(column: Column) -> Column:
    """A value as text that no other value has: ``-`` for null, else its length, a colon and the value, so that several stay apart in a row."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def crc32_text(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def different_buckets(members: DataFrame, key: str, node: str) -> DataFrame:
    """``members`` (distinct pairs of ``key`` and ``node``) without keys of one node, and with one key of those whose nodes are the same:
    pairs that meet under one need not meet under the other. Sets are told apart by their number and 128 bits of their nodes' hashes."""
    xor = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col(node)))
    sets = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), xor(1).alias("_a"), xor(2).alias("_b")).filter("_n > 1")
    once = sets.groupBy("_n", "_a", "_b").agg(F.min(key).alias(key)).select(key)
    return members.join(once, key, "left_semi")


def with_pair_blocks(df: DataFrame, key: list[str], spread: str, block_rows: int) -> DataFrame:
    """Deal the rows of each key into blocks such that every pair of rows meets in one group.

    A key of at most ``block_rows`` rows stays one group. A larger one is cut into ``m`` blocks by the hash of
    ``spread``, and each row goes to the ``m`` groups that pair its block with another (or itself). Adds
    ``lo_block``, ``hi_block`` (the group, with the key) and ``block`` (the row's own). Each group holds about
    two blocks at most, whatever a key holds, so no group grows with the data.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    blocks = F.ceil(F.col("_rows") / F.lit(block_rows)).cast("int")
    return (
        df.join(sizes, key)
        .withColumn("_m", blocks)
        .withColumn("block", F.pmod(F.xxhash64(F.col(spread)), F.col("_m")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("lo_block", F.least("block", "_other"))
        .withColumn("hi_block", F.greatest("block", "_other"))
        .drop("_rows", "_m", "_other")
    )
