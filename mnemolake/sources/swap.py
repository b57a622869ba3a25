"""JSON lines, plain or gzipped, of memory rows."""

from __future__ import annotations

import gzip
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.embed import decode_vector, embedding, encode_vector
from mnemolake.functions.exprs import content_hash, search_text, stored_vector_ok
from mnemolake.operators.dedup import first_by_hash, not_in_store
from mnemolake.schema import DIM, MEMORY, MODEL, conform, ddl

#: What a plain import restores; `full` restores every column.
PLAIN = ("id", "identifier", "fact_text", "source", "importance", "metadata_json", "content_hash", "ttl_seconds", "created_at", "embedding_b64", "embedding_dim", "embedding_model")


def read(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """Memory rows of a file or folder; blank lines are skipped, a malformed line fails the read. gzip needs no option."""
    kinds = ddl(tuple(c for c in MEMORY if c[0] != "embedding")) + ", embedding_b64 string"
    lines = _lines(spark, path).where(F.col("value").rlike(r"\S"))
    rows = lines.select(F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("r"), F.monotonically_increasing_id().alias("line")).select("line", "r.*")
    if not full:
        rows = rows.select("line", *PLAIN)
    rows = rows.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), content_hash(F.col("identifier"), F.col("fact_text"))))
    rows = rows.withColumn("id", F.coalesce("id", F.md5(F.concat_ws(":", F.lit("import"), "content_hash", F.col("line").cast("string")))))
    return rows.withColumn("source", F.coalesce("source", F.lit("swap")))


def with_vectors(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Stored vectors where they fit the model, else embedded anew."""
    ok = stored_vector_ok(F.col("embedding_b64"), F.col("embedding_dim"), F.col("embedding_model"), DIM, model)
    text = search_text() if "fact_summary" in rows.columns else F.col("fact_text")
    out = rows.withColumn("embedding", F.when(ok, decode_vector(F.try_to_binary("embedding_b64", F.lit("base64")))).otherwise(embedding(F.when(~ok, text))))
    return out.withColumn("embedding_model", F.lit(model)).withColumn("embedding_dim", F.lit(DIM)).drop("embedding_b64")


def new_rows(rows: DataFrame, store: DataFrame) -> DataFrame:
    """What an import adds: not in the store by hash, first of equal lines."""
    fresh = not_in_store(first_by_hash(rows, ["line"]), store, "content_hash")
    return conform(with_vectors(fresh))


def as_json(memories: DataFrame, include_embeddings: bool = True) -> Column:
    columns = [F.col(c) for c, _, _ in MEMORY if c != "embedding"]
    if include_embeddings:
        columns.append(F.base64(encode_vector(F.col("embedding"))).alias("embedding_b64"))
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write(memories: DataFrame, path: str, include_embeddings: bool = True, compressed: bool = False) -> None:
    """One file of JSON lines. Beside a compressed one lies an index of its members (`.members`), by which read() gives each member a task."""
    members = write_lines(memories.select(as_json(memories, include_embeddings).alias("value")), path, compressed)
    if compressed:
        _put(memories.sparkSession, f"{path}.members", json.dumps(members).encode())


def write_lines(lines: DataFrame, path: str, compressed: bool = False) -> list[tuple[int, int]]:
    """Makes lines (value), in the order of their partitions, one file; returns (offset, length) of its members.

    Tasks write the parts, which are gzip members if compressed; the driver joins them as bytes through the file system
    and holds none. The file replaces what was there when it is whole.
    """
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(conf)
    if fs.exists(place(path)) and fs.getFileStatus(place(path)).isDirectory():
        raise IsADirectoryError(path)
    parts, whole = f"{path}.parts-{uuid.uuid4().hex}", f"{path}.new-{uuid.uuid4().hex}"
    lines.select("value").write.option("compression", "gzip" if compressed else "none").text(parts)
    found = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(place(parts)) if f.getPath().getName().startswith("part-"))
    members, at, out = [], 0, fs.create(place(whole))
    for name, size in found:
        stream = fs.open(place(f"{parts}/{name}"))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
        members.append((at, size))
        at += size
    if compressed and not at:
        nothing = gzip.compress(b"")
        out.write(bytearray(nothing))
        members = [(0, len(nothing))]
    out.close()
    fs.delete(place(parts), True)
    fs.delete(place(path), False)
    fs.rename(place(whole), place(path))
    _forget_checksum(path)
    return members


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    _forget_checksum(path)


def _forget_checksum(path: str) -> None:
    """A local file that people may edit has no checksum beside it, which a later read would hold it against."""
    folder, name = os.path.split(path.removeprefix("file://"))
    if "://" not in folder and os.path.exists(hidden := os.path.join(folder, f".{name}.crc")):
        os.remove(hidden)


def members_of(path: str) -> list[tuple[int, int]]:
    """(offset, length) of the members of a local compressed file that write() made; none if it has no index that fits it."""
    try:
        with open(f"{path}.members") as f:
            found = [(int(a), int(n)) for a, n in json.load(f)]
        return found if sum(n for _, n in found) == os.path.getsize(path) else []
    except (OSError, ValueError, TypeError):
        return []


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file or folder; a compressed file with an index is read by as many tasks as it has members."""
    members = members_of(path) if path.endswith(".gz") and "://" not in path and os.path.isfile(path) else []
    if len(members) < 2:
        return spark.read.text(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(path, "rb") as f:
                    f.seek(r["at"])
                    inflate, left, rest = zlib.decompressobj(31), r["n"], b""
                    while left and (data := f.read(min(left, 1 << 18))):
                        left -= len(data)
                        lines = (rest + inflate.decompress(data)).split(b"\n")
                        rest = lines.pop()
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], names=["value"])
                    if not inflate.eof:
                        raise ValueError("EOFException: a member ends too early")
                    if rest:
                        yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8", "replace")], pa.string())], names=["value"])

    parts = spark.createDataFrame(members, "at long, n long").repartitionByRange(len(members), "at")
    return parts.mapInArrow(read, "value string")
