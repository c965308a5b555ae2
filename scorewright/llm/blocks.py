"""Shared helpers: partition counts, packed blocks of numbers, word hashes.

Operators that look at every word of the corpus would shuffle one Spark row per word or window. Instead, map
tasks pack the numbers bound for one partition into binary columns (a block), and `repartitionById` deals the
blocks out; a reduce task unpacks numpy arrays. Block sizes are bounded by constants, reduce partitions by
`partitions`, which grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that one worker keeps in a memo, and the longest word that is kept (so that a memo's bytes are bounded); others are computed anew each time.
MEMO, SHORT_WORD = 300_000, 64


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate, or None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else None


def partitions(df: DataFrame, mb: int = 64) -> int:
    """Reduce partitions: the session's setting, more if the input holds more than mb for each."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, math.ceil((input_bytes(df) or 0) / (mb << 20)))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; survives lost executors."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_one_machine: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: on one machine (tests) a temporary one, on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        folder = _one_machine.setdefault("folder", tempfile.mkdtemp(prefix="scorewright-"))
    return folder


def filtered(df: DataFrame, run) -> DataFrame:
    """df through mapInArrow with its own schema; columns come by position, their names may hold any character."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key from which it is hot, and hot keys at most (with more rows, the first number grows).
HOT_ROWS, HOT_KEYS = 100_000, 50_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, hot: int | None = None) -> DataFrame:
    """rows with `value` of table(key, value, n), which has each key of rows once and their number n of rows.

    Keys with very many rows are looked up in a broadcast table, the others by a join, so that no key's rows are gathered.
    As the rows are counted, at most `HOT_KEYS` keys are hot. No key is null. table should be a checkpoint: it is read three times.
    """
    total, top = table.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS if hot is None else hot, (total or 0) // HOT_KEYS)
    if not top or top <= limit:
        return rows.join(table.select(key, value), key)
    many = table.where(F.col("n") > limit).select(key, value)
    found = rows.join(F.broadcast(many), key)
    return found.unionByName(rows.join(F.broadcast(many.select(key)), key, "left_anti").join(table.select(key, value), key))


class WordHash(dict):
    """bytes -> 64-bit hash, with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= SHORT_WORD and len(self) < MEMO:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """Partition 0..n-1 from the high half of 64-bit hashes, evenly."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and xor-shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(31)
        x *= np.uint64(m)
    return x ^ (x >> np.uint64(29))


def id_part(doc_ids: np.ndarray, n: int) -> np.ndarray:
    """The partition of each document id."""
    return part_of(mix(doc_ids.astype(np.int64).view(np.uint64)), n)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, indices in their order) for each partition that occurs."""
    small = part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part
    order = np.argsort(small, kind="stable")
    for s, n in zip(*runs(part[order]), strict=True):
        yield int(part[order[s]]), order[s : s + n]


def batch(schema: pa.Schema, *columns: list | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
