"""Metadata of files: one row for each, nothing loaded beyond what it tells."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.sources.storage import FORMATS, checksum, local_path

SNIFF, SAMPLE = 8192, 5


class UnsupportedFormat(ValueError):
    pass


def sniff_csv(head: str) -> tuple[str, bool]:
    """(delimiter, whether the first line is a header)."""
    try:
        sep = csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        sep = ","
    rows = [r for r in csv.reader(head.splitlines(), delimiter=sep) if r][:2]
    number = lambda x: x.replace(".", "", 1).lstrip("-").isdigit()
    return sep, bool(rows) and not any(number(x) for x in rows[0]) and all(rows[0]) and len(set(rows[0])) == len(rows[0])


def csv_ranges(path: str, header: bool, sample: int) -> list[tuple[int, int]]:
    """(offset, length) of the first records after the header; a newline between quotes ends none. Reads no further than they reach."""
    found, start, quotes = [], 0, 0
    with open(path, "rb") as f:
        while len(found) < sample + header and (line := f.readline()):
            quotes += line.count(b'"')
            if quotes % 2 == 0:
                if f.tell() - start > len(line) or line.strip():
                    found.append((start, f.tell() - start))
                start = f.tell()
    if start < os.path.getsize(path) and quotes % 2:
        found.append((start, os.path.getsize(path) - start))
    return found[int(header) :][:sample]


def inspect_csv(spark: SparkSession, path: str, count_rows: bool = False, sample: int = SAMPLE) -> dict:
    with open(path, "rb") as f:
        head = f.read(SNIFF).decode("utf-8", "replace")
    sep, header = sniff_csv(head)
    df = spark.read.csv(path, sep=sep, header=header, multiLine=True, quote='"', escape='"')
    return {"columns": df.columns, "delimiter": sep, "has_header": header, "row_count": df.count() if count_rows else None, "sample": [r.asDict() for r in df.limit(sample).collect()], "byte_ranges": csv_ranges(path, header, sample)}


def jsonl_lines(df: DataFrame, line: str, text: str) -> DataFrame:
    """(line, valid, keys) of lines that aren't blank."""
    rows = df.where(F.col(text).rlike(r"\S"))
    return rows.select(line, F.try_parse_json(text).isNotNull().alias("valid"), F.json_object_keys(text).alias("keys"))


def jsonl_summary(lines: DataFrame, line: str) -> DataFrame:
    """One row: rows, invalid rows and the first of them; partial aggregates only."""
    return lines.agg(F.count("*").alias("rows"), F.count_if(~F.col("valid")).alias("invalid"), F.min(F.when(~F.col("valid"), F.col(line))).alias("first_invalid"))


def jsonl_columns(lines: DataFrame, line: str) -> DataFrame:
    """(key, first_line, place, n): keys by where they are first seen. Buffers are longs, so that they live in a hash aggregate."""
    seen = lines.where("valid").select(line, F.posexplode_outer("keys").alias("place", "key")).where("key IS NOT NULL")
    return seen.groupBy("key").agg(F.min(line).alias("first_line"), F.min_by("place", line).alias("place"), F.count("*").alias("n"))


def jsonl_head(path: str, sample: int) -> tuple[list[dict], list[tuple[int, int]]]:
    """The first records and the (offset, length) of each; reads no further than they reach."""
    records, ranges = [], []
    with open(path, "rb") as f:
        while len(records) < sample and (line := f.readline()):
            try:
                record = json.loads(line)
            except ValueError:
                continue
            if isinstance(record, dict):
                records.append(record)
                ranges.append((f.tell() - len(line), len(line)))
    return records, ranges


def line_number(df: DataFrame, line: int) -> int:
    """The number, from 0, of a line that is named by its partition and its place there: lines of earlier partitions are counted."""
    part, place = line >> 33, line & ((1 << 33) - 1)
    return place + (df.where(F.shiftright("line", 33) < part).count() if part else 0)


def inspect_jsonl(spark: SparkSession, path: str, count_rows: bool = True, sample: int = SAMPLE) -> dict:
    """Every line is parsed, in tasks; the first records are read at the head of the file. A line ends at a newline alone."""
    df = spark.read.text(path, lineSep="\n").withColumn("line", F.monotonically_increasing_id())
    lines = jsonl_lines(df, "line", "value")
    told = jsonl_summary(lines, "line").first()
    keys = [r.key for r in jsonl_columns(lines, "line").orderBy("first_line", "place").collect()]
    records, ranges = jsonl_head(path, sample)
    reason = None if told.first_invalid is None else f"line {line_number(df, told.first_invalid)} isn't JSON"
    return {"columns": keys, "row_count": told.rows, "invalid": told.invalid, "delimiter": "\n", "sample": records, "byte_ranges": ranges, "unsupported_reason": reason}


def inspect_parquet(spark: SparkSession, path: str, count_rows: bool = True, sample: int = SAMPLE) -> dict:
    """From the footer alone; a malformed file has a reason and raises nothing."""
    try:
        meta = pq.read_metadata(path)
    except Exception as error:  # noqa: BLE001  whatever makes it unreadable is the reason
        return {"columns": [], "unsupported_reason": str(error)}
    leaves = [meta.schema.column(i) for i in range(meta.num_columns)]
    return {"columns": [c.path for c in leaves], "types": [c.physical_type for c in leaves], "row_count": meta.num_rows, "row_groups": meta.num_row_groups, "version": meta.format_version, "unsupported_reason": None}


INSPECTORS: dict[str, Callable] = {"csv": inspect_csv, "jsonl": inspect_jsonl, "parquet": inspect_parquet}


def register(kind: str, inspector: Callable) -> None:
    INSPECTORS[kind] = inspector


def inspect(spark: SparkSession, uri: str, count_rows: bool = False, sample: int = SAMPLE) -> dict:
    path = local_path(uri)
    kind = FORMATS.get(os.path.splitext(path)[1].lower(), "")
    if kind not in INSPECTORS:
        raise UnsupportedFormat(uri)
    return {"uri": uri, "format": kind, "size": os.path.getsize(path), "mtime": os.path.getmtime(path), "checksum": checksum(path)} | INSPECTORS[kind](spark, path, count_rows, sample)
