"""Scans and sinks of governed tables: fixed schemas, fail fast, atomic writes."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.tables import cut

# The sensor table. The first header name is empty in the source file.
CONTINUOUS = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
BINARY = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")
HEADER = ("", "timestamp", *CONTINUOUS, *BINARY)
SENSOR = T.StructType(
    [T.StructField("C0", T.LongType()), T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in (*CONTINUOUS, *BINARY)]
)


class GovernanceError(ValueError):
    """A table or file is not what it was agreed to be."""


def sha256_file(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``, by Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_header(spark: SparkSession, path: str, expected: tuple[str, ...] = HEADER) -> None:
    """The first line of every file must be exactly the expected names, empty ones included."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", "id").alias("v")).select("file", F.rtrim(F.regexp_replace("v", "^\ufeff", ""), F.lit("\r")).alias("v"))
    odd = first.where(F.col("v") != F.lit(",".join(expected))).orderBy("file").first()
    if odd is not None or first.isEmpty():
        raise GovernanceError(f"header {tuple(odd['v'].split(',')) if odd else None} is not {expected}")


#: Blocks of files (splits) whose index is broadcast to their lines; a longer index is joined by shuffle.
BROADCAST_BLOCKS = 500_000


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_in_file, position, value) of the lines of all files below ``path``; ``position`` counts from 1 as one reader would that takes the files by name, one after the other.

    Tasks read splits, of one file or of several, in an order of Spark's own. The lines of a
    split have consecutive row ids, so a first pass counts each split's lines and notes its
    first id; sums over the splits before give where the split begins in its file, and
    sums over files where the file begins. The second pass is a map over the scan: nothing is sorted, and
    only one row per split is shuffled. Both passes read the same file listing with the
    same split size; if ids didn't agree the read would stop.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    splits = lines.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = cut(splits.withColumn("__at", before(W.partitionBy("file").orderBy("__block"))))
    of_file = splits.groupBy("file").agg(F.sum("__n").alias("__n"))  # one row per file
    of_file = of_file.select(F.col("file").alias("__f"), before(W.orderBy("file")).alias("__start"))
    index = splits.join(of_file, F.col("file") == F.col("__f")).drop("__f").withColumnsRenamed({"file": "__f", "__block": "__b"})
    if splits.count() <= BROADCAST_BLOCKS:
        index = F.broadcast(index)
    found = lines.join(index, (F.col("file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    at = F.col("__id") - F.col("__first")
    at = F.when((at >= 0) & (at < F.col("__n")), at).otherwise(F.raise_error(F.lit("the second pass over the files met other splits than the first")))
    in_file = F.col("__at") + at + 1
    return found.select("file", in_file.alias("line_in_file"), (F.col("__start") + in_file).alias("position"), "value")


def raw_csv(spark: SparkSession, path: str, header: tuple[str, ...] = HEADER) -> DataFrame:
    """Untyped rows with ``position`` in file order and ``width``: short rows are padded, long ones cut.

    One line is one row; quoted line breaks aren't part of the format. A folder is read file
    by file in the order of names (``lines_in_order``); the header is taken off where it is a file's
    first line, and counts as a position.
    """
    lines = lines_in_order(spark, path).withColumn("value", F.regexp_replace("value", "[\ufeff\r]", ""))
    d = lines.where((F.col("line_in_file") > 1) | (F.col("value") != F.lit(",".join(header)))).withColumn("c", F.split("value", ",", -1))
    names = [h or "C0" for h in header]
    return d.select("position", F.size("c").alias("width"), *[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def typed_csv(spark: SparkSession, path: str, schema: T.StructType = SENSOR) -> DataFrame:
    """Typed rows; a cell that doesn't parse stops the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSS]").csv(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, expected_rows: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """zstd Parquet; the committer makes the folder appear whole or not at all."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    if expected_rows is not None:
        check_parquet(df.sparkSession, path, None, expected_rows)


def check_parquet(spark: SparkSession, path: str, schema: T.StructType | None = SENSOR, expected_rows: int | None = None) -> dict[str, Any]:
    """Schema and row count of a written table, or an error."""
    d = spark.read.parquet(path)
    if schema is not None and [(f.name, f.dataType) for f in d.schema] != [(f.name, f.dataType) for f in schema]:
        raise GovernanceError(f"schema of {path} is {d.schema.simpleString()}")
    n = d.count()
    if expected_rows is not None and n != expected_rows:
        raise GovernanceError(f"{path} has {n} rows, not {expected_rows}")
    return {"rows": n, "columns": len(d.columns), "schema": d.schema.simpleString()}


def with_headers(lines: DataFrame, header: tuple[str, ...] = HEADER) -> DataFrame:
    """Lines (value) with a header line before those of each partition that has any, so that each file written of them begins with one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in it:
            if b.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([",".join(header)], b.schema.field(0).type)], schema=b.schema)
            yield b

    return lines.select("value").mapInArrow(run, "value string")


def convert(spark: SparkSession, csv: str, parquet: str, overwrite: bool = False) -> dict[str, Any]:
    """CSV to Parquet with the header, the row count and the schema checked on both sides."""
    check_header(spark, csv)
    d = typed_csv(spark, csv)
    lines = spark.read.text(csv).where("trim(value) <> ''").groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n"))
    n = lines.agg(F.sum(F.col("n") - 1)).first()[0] or 0  # each file has a header
    write_parquet(d, parquet, overwrite)
    return check_parquet(spark, parquet, SENSOR, n) | {"source_rows": n}


def inspect(spark: SparkSession, path: str, ts: str = "timestamp") -> DataFrame:
    """(rows, columns, first, last): what a governed series holds."""
    d = spark.read.parquet(path)
    return d.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(d.columns)).alias("columns"), F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"))


def load_json(path: str | Path) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise GovernanceError(f"{path} is not a JSON object")
    return value


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_json(value: Any, path: str | Path, overwrite: bool = True) -> None:
    """Sorted, indented, in place at once or not at all. For reports on the driver."""
    _write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n", path, overwrite)


def write_text(lines: Iterable[str], path: str | Path, overwrite: bool = True) -> None:
    _write_text("\n".join(lines) + "\n", path, overwrite)


def _write_text(text: str, path: str | Path, overwrite: bool) -> None:
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def write_csv_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "source_id", "source_title", "publisher", "source_url", "doi", "classification", "equipment_relevance", "license_or_usage_status", "retrieval_identity", "scope_note", "source_sha256", "locator")]
    + [T.StructField(c, T.IntegerType()) for c in ("unit_index", "unit_chunk_index", "source_chunk_index", "word_count")]
    + [T.StructField(c, T.StringType()) for c in ("text_sha256", "text")]
)


def read_chunks(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Chunks from JSON lines: unparsable rows, repeated ids, a wrong count or a text that isn't its checksum's are errors."""
    d = spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(~F.col("text_sha256").eqNullSafe(F.sha2("text", 256))).alias("bad")).first()
    if r["bad"] or r["ids"] != r["n"] or (expected is not None and r["n"] != expected):
        raise GovernanceError(f"{r['n']} chunks, {r['ids']} ids, {r['bad']} texts that don't match their checksum")
    return d


def write_chunks(chunks: DataFrame, path: str, overwrite: bool = False) -> None:
    chunks.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_normalized(units: DataFrame, path: str, overwrite: bool = False, source: str = "source_id", unit: str = "unit_index") -> None:
    """One text file per source, in a folder named by it: each unit under a line with its locator, blank lines between.

    Only the first and last unit of a source are looked up, so no text is windowed; the
    units of one source are sorted where their one file is written.
    """
    ends = units.groupBy(source).agg(F.min(unit).alias("__a"), F.max(unit).alias("__z"))
    d = units.join(ends.withColumnRenamed(source, "__s"), F.col(source).eqNullSafe(F.col("__s")))
    block = F.concat(F.lit("===== "), F.coalesce("locator", F.lit("")), F.lit(" =====\n\n"), F.coalesce("text", F.lit("")))
    block = F.when(F.col(unit) == F.col("__z"), F.regexp_replace(block, r"\s+\z", "")).otherwise(block)
    d = d.select(source, unit, F.when(F.col(unit) == F.col("__a"), block).otherwise(F.concat(F.lit("\n"), block)).alias("value"))
    d.repartition(source).sortWithinPartitions(source, unit).select(source, "value").write.mode("overwrite" if overwrite else "errorifexists").partitionBy(source).text(path)


def text_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of plain-text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pdf_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, unit_index, locator, text) of the pages of PDF files; needs the optional library pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise GovernanceError("reading PDF files needs pypdf") from e

    def pages(it):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for b in it:
            rows = [(p, i, f"page:{i}", t or "") for p, c in zip(b["path"], b["content"], strict=True) for i, t in enumerate((x.extract_text() for x in PdfReader(io.BytesIO(c)).pages), start=1)]
            yield pd.DataFrame(rows, columns=["path", "unit_index", "locator", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, unit_index int, locator string, text string")
