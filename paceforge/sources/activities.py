"""Reading activity exports."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceforge import schema
from paceforge.session import stage

_OPTIONS = {"escape": '"'}


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of files as (file, block, value); a file's blocks are its splits, in order of their start."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _surveyed(spark: SparkSession, path: str) -> DataFrame:
    """Per file block: its first line, quotes, and whether any line ends inside quotes.

    A line of an odd number of quotes opens or closes a field that goes over its end.
    """
    lines = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    return lines.groupBy("file", "block").agg(
        F.min_by("value", "at").alias("first"),
        F.sum(_quotes(F.col("value"))).alias("quotes"),
        F.max(_quotes(F.col("value")) % 2 == 1).alias("broken"),
    )


def _files(blocks: DataFrame) -> dict[str, tuple[list[str], list[str]]]:
    """Header line to files without and with broken lines; as many entries as Spark lists on the driver."""
    files = blocks.groupBy("file").agg(F.min_by("first", "block").alias("header"), F.max("broken").alias("broken"))
    out: dict[str, tuple[list[str], list[str]]] = {}
    for row in files.orderBy("file").collect():
        groups = out.setdefault(row["header"].lstrip("\ufeff"), ([], []))
        groups[bool(row["broken"])].append(unquote(row["file"]))
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of a block, and what its ends share with its neighbours.

    Lines come block by block in their order, each with ``open``, whether the block starts inside quotes.
    ``part``: null for a record; 0 for lines that end a record of an earlier block (or run through), 1 for a
    record that the block doesn't end.
    """
    held: list[str] = []
    place, inside, tail = None, False, False
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((*place, 1 if tail else 0, "\n".join(held)))
            held.clear()

    for batch in batches:
        for file, block, opened, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "open", "value"))):
            if (file, block) != place:
                close()
                place, inside, tail = (file, block), bool(opened), not opened
            held.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                if tail:
                    out.append((file, block, None, "\n".join(held)))
                    held.clear()
                else:
                    close()
                tail = True
        if out:
            yield _batch(out)
            out = []
    close()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "part", "record"])


def _joined_records(spark: SparkSession, files: list[str], blocks: DataFrame) -> DataFrame:
    """(file, record) of files with line breaks in quotes, read block by block.

    The quotes of the blocks before say whether a block starts inside a field. Records that cross a border
    are put together from a few lines per block.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("open")
    starts = blocks.select("file", "block", opened)
    # a hint to broadcast: one row per 128 MB of input, and the lines must stay in their order
    lines = _lines(spark, files).join(F.broadcast(starts), ["file", "block"]).select("file", "block", "open", "value")
    parts = lines.mapInArrow(_records, "file string, block long, part int, record string")
    ends = parts.filter("part IS NOT NULL")
    so_far = Window.partitionBy("file").orderBy("block", "part")
    numbered = ends.withColumn("number", F.sum("part").over(so_far))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "record"))), lambda x: x["record"])
    crossing = numbered.groupBy("file", "number").agg(F.array_join(pieces, "\n").alias("record"))
    return parts.filter("part IS NULL").select("file", "record").unionByName(crossing.select("file", "record"))


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """CSV export (a file, or a folder of files) as text columns.

    The schema comes from the header lines, so nothing is inferred from the data. Files of a folder may
    differ in their columns and in the order of these: files with equal headers are read together, the
    groups are united by column name, and what a file lacks is null.

    Large files are read by many tasks. One pass over the lines counts quotes; files in which every line
    has an even number go to Spark's own reader. In the others records may go over line ends: their lines
    are joined to records by the quotes before them, and a line break inside a field is read as ``\\n``.
    """
    blocks = stage(_surveyed(spark, path), "csv-blocks")
    groups = _files(blocks)
    parts = []
    for header, (plain, broken) in groups.items():
        names = schema.unique_names(name.strip() for name in next(csv.reader([header])))
        fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if plain:
            parts.append(spark.read.schema(fields).option("header", True).options(**_OPTIONS).csv(plain if broken or len(groups) > 1 else path))
        if broken:
            records = _joined_records(spark, broken, blocks)
            rows = records.filter(F.ltrim(F.col("record"), F.lit("\ufeff")) != header).filter("trim(record) <> ''")
            row = F.from_csv("record", ", ".join(f"`{n.replace('`', '``')}` string" for n in names), _OPTIONS)
            parts.append(rows.select(row.alias("r")).select("r.*"))
    if not parts:
        raise ValueError(f"{path} is empty")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage written by :mod:`paceforge.sources.sinks`."""
    return spark.read.parquet(path)
