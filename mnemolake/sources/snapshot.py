"""Snapshot folders: a manifest with checksums, memory rows as JSON lines, optional attachments."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.embed import pack
from mnemolake.operators.lists import ordered_hash
from mnemolake.schema import MEMORY, ddl
from mnemolake.sources import swap
from mnemolake.sources.storage import checksum, confined, read_references

MANIFEST, ROWS, NOTES, ATTACHMENTS = "manifest.json", "memories.jsonl", "metadata.json", "attachments"
#: Keys of a record, by the column that each holds.
RECORD = ("id", "identifier", "memory_type", "fact_text", "fact_summary", "embedding_dim", "embedding_model", "source", "importance", "content_hash", "source_uri", "byte_offset", "byte_length", "source_checksum", "source_format", "created_at")


class SnapshotError(ValueError):
    def __init__(self, reason: str, file: str = ""):
        super().__init__(f"{reason} {file}".strip())
        self.reason, self.file = reason, file


def _json(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _record(row: dict) -> dict:
    out = {"schema_version": 2} | {k: row[k] for k in RECORD}
    out["embedding"] = base64.b64encode(pack(row["embedding"])).decode() if row["embedding"] else None
    return out | {"metadata": _json(row["metadata_json"]), "provenance": _json(row["provenance_json"])}


def records(memories: DataFrame) -> DataFrame:
    """(value): a record as a line for each row, in order of id over ranges; made in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [json.dumps(_record(r), sort_keys=True, default=str) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return memories.select(*RECORD, "embedding", "metadata_json", "provenance_json").orderBy("id").mapInArrow(run, "value string")


def overall(digests: dict[str, str]) -> str:
    return hashlib.sha256("".join(digests[name] for name in sorted(digests)).encode()).hexdigest()


def _attached(files: DataFrame, folder: str, base: str | None, below: int) -> dict[str, dict]:
    """Copies what small references refer to; what each id is attached as. Tasks read and check the ranges, the driver writes what it is given, below `below` bytes each."""
    small = files.where((F.col("byte_length") > 0) & (F.col("byte_length") < below))
    uris, out = {r.id: r.source_uri for r in small.select("id", "source_uri").toLocalIterator()}, {}
    for r in read_references(small, base, verify=False).where("content IS NOT NULL").toLocalIterator():
        data = bytes(r.content)
        name = hashlib.sha256(data).hexdigest()
        path = os.path.join(folder, ATTACHMENTS, name)
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(data)
        out[r.id] = {"name": name, "source_uri": uris[r.id], "size": len(data), "sha256": name}
    return out


def write(memories: DataFrame, folder: str, copy_attachments: bool = False, base: str | None = None, attach_below: int = 8192) -> dict:
    """Writes rows in order of id, made in tasks and joined as one file; the manifest comes last.

    Sums and the digest of all hashes are Spark jobs. The manifest lists the references of file rows, which is what the
    driver holds.
    """
    os.makedirs(folder, exist_ok=True)
    swap.write_lines(records(memories), os.path.join(folder, ROWS))
    file = F.col("memory_type").eqNullSafe("file")
    total, of_files = memories.agg(F.count("*"), F.count_if(file)).first()
    digest = ordered_hash(memories, "content_hash").first()[0]
    files = memories.where(file & (F.col("source_uri") != "")).select("id", "source_uri", "source_format", "source_checksum", F.coalesce("byte_offset", F.lit(0)).alias("byte_offset"), F.coalesce("byte_length", F.lit(0)).alias("byte_length"))
    attached = _attached(files, folder, base, attach_below) if copy_attachments else {}
    references = [
        {k: r[k] for k in ("source_uri", "source_format", "source_checksum", "byte_offset", "byte_length")} | {"memory_id": r.id, "attachment": attached[r.id]["name"] if r.id in attached else None}
        for r in files.orderBy("id").toLocalIterator()
    ]
    kept = {a["name"]: a for _, a in sorted(attached.items(), reverse=True)}
    written = {ROWS: {"size": os.path.getsize(os.path.join(folder, ROWS)), "sha256": checksum(os.path.join(folder, ROWS))}}
    written |= {f"{ATTACHMENTS}/{n}": {"size": a["size"], "sha256": a["sha256"]} for n, a in kept.items()}
    now = dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    with open(os.path.join(folder, NOTES), "w") as f:
        json.dump({"created_at": now, "counts": {"inline": total - of_files, "file": of_files, "total": total}}, f, sort_keys=True, indent=2)
    manifest = {
        "schema_version": 2, "snapshot_id": digest, "created_at": now, "memory_count": total, "inline_count": total - of_files, "file_backed_count": of_files,
        "files": written, "overall_sha256": overall({k: v["sha256"] for k, v in written.items()}), "file_backed_references": references, "attachments": [kept[k] for k in sorted(kept)],
    }
    with open(os.path.join(folder, MANIFEST), "w") as f:
        json.dump(manifest, f, sort_keys=True, indent=2)
    return manifest


def verify(folder: str) -> dict:
    """The manifest, if each listed file has its size and digest, and all together theirs. Other files are ignored."""
    path = os.path.join(folder, MANIFEST)
    if not os.path.isfile(path):
        raise SnapshotError("missing_manifest", path)
    try:
        with open(path) as f:
            manifest = json.load(f)
        listed = {name: (int(x["size"]), str(x["sha256"])) for name, x in manifest["files"].items()}
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise SnapshotError("malformed", path) from error
    for name, (size, digest) in listed.items():
        file = os.path.join(folder, name)
        if not confined(file, folder) or not os.path.isfile(file):
            raise SnapshotError("missing_file", name)
        if os.path.getsize(file) != size or checksum(file) != digest:
            raise SnapshotError("mismatch", name)
    if overall({k: v[1] for k, v in listed.items()}) != manifest.get("overall_sha256"):
        raise SnapshotError("mismatch", "overall")
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Verified rows as swap rows: (line, columns, embedding_b64)."""
    verify(folder)
    kinds = ddl(tuple(c for c in MEMORY if c[0] in RECORD)) + ", embedding string, metadata string, provenance string"
    lines = spark.read.text(os.path.join(folder, ROWS)).where(F.col("value").rlike(r"\S"))
    rows = lines.select(F.monotonically_increasing_id().alias("line"), F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")
    return rows.withColumnsRenamed({"embedding": "embedding_b64", "metadata": "metadata_json", "provenance": "provenance_json"})


def detect(path: str) -> str:
    """The format of an existing path: snapshot, bundle, swap, sqlite; or missing_manifest."""
    if path.endswith((".jsonl", ".jsonl.gz")):
        return "swap"  # one file, or a folder of parts
    if os.path.isdir(path):
        names = set(os.listdir(path))
        if MANIFEST in names and ROWS in names:
            return "snapshot"
        if names & {"memory.md", "index.md", "README.md"}:
            return "bundle"
        if ROWS in names:
            return "legacy"
        raise SnapshotError("missing_manifest", path)
    return "sqlite" if path.endswith((".db", ".sqlite", ".sqlite3")) else "swap"


#: Importers of further formats by the kind that detect() or a caller names: (spark, path) to swap rows.
IMPORTERS: dict[str, Callable] = {}


def register(kind: str, importer: Callable) -> None:
    IMPORTERS[kind] = importer


def load(spark: SparkSession, path: str, sources: dict[str, Callable] | None = None, kind: str | None = None) -> DataFrame:
    """Rows to import from a path of any known format; a missing path has none."""
    if not os.path.exists(path):
        return spark.createDataFrame([], ddl(MEMORY)).withColumn("line", F.lit(0).cast("long")).withColumn("embedding_b64", F.lit(None).cast("string"))
    from mnemolake.sources import bundle, sqlite

    kind = kind or detect(path)
    if kind == "legacy":
        return swap.read(spark, os.path.join(path, ROWS))
    return ({"snapshot": read, "bundle": bundle.read, "sqlite": sqlite.read_memories, "swap": swap.read} | IMPORTERS | (sources or {}))[kind](spark, path)
