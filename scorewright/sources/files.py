"""Readers and writers of the record files: JSON arrays, JSON lines, CSV, manifests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import checkpointed
from pyspark.sql.window import Window


def read_json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Files that hold one JSON array (or document) each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, paths, schema: str) -> DataFrame:
    """JSON lines of one or several files; blank lines give no row."""
    return spark.read.schema(schema).json(paths)


def read_keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last row of each key, in file order."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))  # file by file; a task reads a block in order
    placed = spark.read.text(path).select("value", at.alias("_at")).where(F.trim("value") != "")
    rows = placed.select(F.from_json("value", schema).alias("r"), "_at").select("r.*", "_at")
    last = Window.partitionBy(key).orderBy(F.desc("_at"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_at")


def sniff(spark: SparkSession, path: str) -> bool:
    """True if the file is one JSON array: its first line that is not blank starts with a bracket."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Either form, chosen by the first character."""
    return read_json_array(spark, path, schema) if sniff(spark, path) else read_jsonl(spark, path, schema)


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_articles(spark: SparkSession, folder: str, schema: str, regulations: list[str] | None = None) -> DataFrame:
    """All *_articles.json files of a folder, one row per article, with the file's name."""
    files = read_json_array(spark, f"{folder}/*_articles.json", schema).withColumn("file", F.input_file_name())
    rows = files.select("file", F.explode("articles").alias("a")).select("file", "a.*")
    return rows.where(F.col("regulation").isin(regulations)) if regulations else rows


def read_page_texts(spark: SparkSession, path: str, parse) -> DataFrame:
    """Binary files to (path, text) by an injected parser of one file's bytes (PDF libraries are the caller's)."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[parse(bytes(c)) for c in pdf["content"]])[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def union_csv(frames: list[DataFrame]) -> DataFrame:
    """Rows of different shape under the sorted union of their columns, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; append adds files and leaves the ones there as they are."""
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def _framed(rows: DataFrame, path: str, head: str, tail: str) -> None:
    """One text of a head, the rows as JSON with commas between them, and a tail. A document is one file, so one task writes it; it holds a batch."""

    def run(batches):
        first = True
        for b in batches:
            lines = []
            for place, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines.append(value if place != 1 or first else f",{value}")
                first = first and place != 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    lines = rows.select(F.lit(1).alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, head), (2, tail)], "place int, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("place").mapInArrow(run, "value string").write.mode("errorifexists").text(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array, a row in each line."""
    _framed(df, path, "[", "]")


def rewrite_as_array(spark: SparkSession, source: str, path: str, schema: str) -> None:
    """JSON lines to one JSON array."""
    write_json_array(read_jsonl(spark, source, schema), path)


def write_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """One JSON document of a summary (one row) and the results (a list)."""
    _framed(results, path, '{"summary": ' + summary.select(F.to_json(F.struct("*"))).first()[0] + ', "results": [', "]}")


def _framed_parts(rows: DataFrame, path: str, head: str, tail: str) -> None:
    """The lines of `_framed` as part files: one after another, in the order of their names, they are the document.

    Each task writes its own rows; the first row of all has no comma before it, and the head and the tail are files of their own.
    """
    lines = checkpointed(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")))
    numbered = lines.withColumn("i", F.monotonically_increasing_id())  # grows with the partition, then with the row
    first = numbered.agg(F.min("i")).first()[0]
    body = numbered.select(F.when(F.col("i") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"))
    end = lambda text: rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    end(head).union(body).union(end(tail)).write.mode("errorifexists").text(path)


def write_array_parts(df: DataFrame, path: str) -> None:
    """A JSON array in part files; `cat path/part-*` is the array, a row in each line."""
    _framed_parts(df, path, "[", "]")


def rewrite_as_array_parts(spark: SparkSession, source: str, path: str, schema: str) -> None:
    """JSON lines to a JSON array in part files, each task on its own."""
    write_array_parts(read_jsonl(spark, source, schema), path)


def read_array_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of part files of a JSON array or of a report's results, by any number of tasks; lines of the frame are none."""
    lines = spark.read.text(path).where(~F.col("value").isin("[", "]", "]}") & ~F.col("value").endswith(": ["))
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r")).select("r.*")


def write_report_parts(summary: DataFrame, results: DataFrame, path: str) -> None:
    """One JSON document of a summary (one row) and the results (a list), in part files."""
    _framed_parts(results, path, '{"summary": ' + summary.select(F.to_json(F.struct("*"))).first()[0] + ', "results": [', "]}")


def read_report_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The summary of a report in part files."""
    head = spark.read.text(path).where(F.col("value").startswith('{"summary": ') & F.col("value").endswith(', "results": ['))
    return head.select(F.from_json(F.regexp_extract("value", '^\\{"summary": (.*), "results": \\[$', 1), schema).alias("s")).select("s.*")


def write_json_document(df: DataFrame, path: str) -> None:
    """Each row as an indented JSON document."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("errorifexists").text(path)


def joined_hash(ids: DataFrame) -> DataFrame:
    """(split_hash): SHA-256 of the ids (one string column), sorted and joined by |; nulls are left out.

    A hash of a sequence can't be put together from parts: one task sorts the ids (on disk, if need be) and keeps none.
    """

    def run(batches):
        digest, first = hashlib.sha256(), True
        for b in batches:
            for x in b.column(0):
                digest.update(("" if first else "|").encode() + x.as_py().encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["split_hash"])

    name = ids.columns[0]
    rows = ids.where(F.col(name).isNotNull()).repartition(1).sortWithinPartitions(name).mapInArrow(run, "split_hash string")
    return rows.agg(F.coalesce(F.max("split_hash"), F.lit(hashlib.sha256().hexdigest())).alias("split_hash"))  # one row, also without ids


def tree_hash(ids: DataFrame, digits: int = 3) -> DataFrame:
    """(tree_hash): a hash of a set of ids (one string column) that parts can be put together for; nulls are left out.

    Ids are dealt by the first `digits` hex digits of their SHA-256. A part's hash is the SHA-256 of its ids, sorted and joined by |; the result
    is the SHA-256 of the parts' hashes in the order of their digits, joined by |. A task holds one part of 16 ** digits; the last step has a row for each part.
    """
    name = ids.columns[0]
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    parts = ids.where(F.col(name).isNotNull()).groupBy(F.substring(sha(F.col(name)), 1, digits).alias("part")).agg(sha(F.array_join(F.array_sort(F.collect_list(name)), "|")).alias("h"))
    return parts.agg(sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda p: p["h"]), "|")).alias("tree_hash"))


def manifest(split: DataFrame, seed: int) -> DataFrame:
    """One row: seed, sizes of train, val and test, SHA-256 over the sorted ids, and the date."""
    size = lambda s: F.count_if(F.col("split") == s).alias(s)
    sizes = split.agg(F.struct(size("train"), size("val"), size("test")).alias("sizes"))
    rows = sizes.crossJoin(joined_hash(split.select(F.col("question_id").cast("string").alias("id"))))  # one row each
    return rows.select(F.lit(seed).alias("seed"), "sizes", "split_hash", F.current_timestamp().cast("string").alias("date_created"))
