"""MemoryStore: one method for each thing that a caller of a memory service does."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.embed import embed
from mnemolake.operators import events as log
from mnemolake.operators import hydrate, hygiene, lifecycle, lists, search
from mnemolake.schema import DIM, EVENT, MEMORY, MODEL, conform, ddl
from mnemolake.sources import bundle, inspectors, snapshot, sqlite, storage, swap
from mnemolake.store import Store


class NotFound(KeyError):
    pass


class MemoryStore:
    def __init__(self, spark: SparkSession, root: str, base_dir: str | None = None):
        self.spark, self.store, self.base = spark, Store(spark, root), base_dir

    # what is known

    def count(self) -> int:
        return self.store.count()

    def get(self, memory_id: str) -> dict:
        row = lists.by_id(self.store.memories(), memory_id).first()
        if row is None:
            raise NotFound(memory_id)
        return row.asDict()

    def list(self, identifier: str, order: str = "asc", limit: int = 100) -> DataFrame:
        if order not in ("asc", "desc") or not 1 <= limit <= 1000:
            raise ValueError("order is asc or desc, limit 1 to 1000")
        return lists.by_identifier(self.store.memories(), identifier, self._now(), order == "asc", limit)

    def search(self, query: str, top_k: int = 5, max_chars: int | None = None, include_archived: bool = False) -> DataFrame:
        if not 1 <= top_k <= 100:
            raise ValueError("top_k is 1 to 100")
        ranked = search.hybrid_of_scores(self.store.current(), self.store.bm25(query), query, top_k, self._now(), include_archived)
        return search.messages(ranked if max_chars is None else search.budgeted(ranked, max_chars))

    def context(self, query: str, top_k: int = 5) -> str:
        return search.context_block(search.hybrid_of_scores(self.store.current(), self.store.bm25(query), query, top_k, self._now())).first()[0]

    def files(self, identifier: str | None = None) -> DataFrame:
        rows = lists.file_backed(self.store.memories())
        return rows if identifier is None else rows.where(F.col("identifier") == identifier)

    def hydrate(self, memory_id: str, profile: str | None = None, verify: bool = True) -> dict:
        rows = lists.by_id(self.store.memories(), memory_id)
        if profile in ("compact", "agent"):
            found = lists.profile(rows, profile).first()
        elif profile in ("audit", "full"):
            found = hydrate.audit(rows, self.base, verify, profile == "full").first()
        elif profile is None:
            found = hydrate.hydrate(rows, self.base, verify).first()
            if found and found.reason:
                raise storage.ProvenanceError(found.reason, memory_id)
        else:
            raise ValueError(f"unknown profile: {profile}")
        if found is None:
            raise NotFound(memory_id)
        return found.asDict()

    def hydrate_batch(self, ids: list[str], verify: bool = True) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
        return hydrate.hydrate_many(self.store.memories(), asked, self.base, verify)

    def hydrate_all(self, ids: list[str], verify: bool = True) -> list[dict]:
        """Contents in the order of ids; raises at the first that is unknown or can't be read."""
        found = []
        for r in self.hydrate_batch(ids, verify).toLocalIterator():
            if r.reason == "not_found":
                raise NotFound(r.id)
            if r.reason:
                raise storage.ProvenanceError(r.reason, r.id)
            found.append({"id": r.id, "content": bytes(r.content), "verified": r.verified})
        return found

    def hydrate_profiles(self, ids: list[str], profile: str | None, verify: bool = True) -> dict[str, dict]:
        """hydrate() of many ids as one join: what is known of each; a failed read is in `reason` or `warning`."""
        asked = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        rows = self.store.memories().join(asked, "id", "left_semi")
        if profile in ("compact", "agent"):
            found = lists.profile(rows, profile)
        elif profile in ("audit", "full"):
            found = hydrate.audit(rows, self.base, verify, profile == "full")
        elif profile is None:
            found = hydrate.hydrate(rows, self.base, verify)
        else:
            raise ValueError(f"unknown profile: {profile}")
        return {r.id: r.asDict() for r in found.toLocalIterator()}

    # what changes

    def add(self, identifier: str, fact: str | None = None, file_uri: str | None = None, byte_offset: int | None = None, byte_length: int | None = None, importance: float = 0.5, ttl_seconds: int | None = None, summary: str | None = None, **columns) -> str:
        """Adds one row and its event in one step; a row of equal id or hash is replaced."""
        if (fact is None) == (file_uri is None):
            raise ValueError("give a fact or a file")
        if not 0 <= importance <= 1 or ttl_seconds is not None and ttl_seconds < 1:
            raise ValueError("importance is 0 to 1, ttl_seconds at least 1")
        row = {"id": uuid.uuid4().hex, "identifier": identifier, "importance": float(importance), "ttl_seconds": ttl_seconds, "created_at": self._stamp(), "embedding_dim": DIM, "fact_summary": summary} | columns
        import hashlib

        if file_uri is None:
            row |= {"fact_text": fact, "embedding": embed(fact), "embedding_model": MODEL, "content_hash": hashlib.sha256(f"{identifier}:{fact}".encode()).hexdigest()}
        else:
            if byte_offset is None or byte_length is None or byte_offset < 0 or byte_length < 0:
                raise ValueError("a file needs an offset and a length")
            path = storage.local_path(file_uri, self.base)
            if not os.path.exists(path):
                raise FileNotFoundError(file_uri)
            data = storage.read_range(path, byte_offset, byte_length)
            digest = columns.get("source_checksum") or hashlib.sha256(data).hexdigest()
            row |= {"fact_text": "", "memory_type": "file", "source_uri": file_uri, "byte_offset": byte_offset, "byte_length": byte_length, "source_checksum": digest, "source_format": storage.metadata(path)["format"]}
            row |= {"embedding": embed(summary) if summary else [], "embedding_model": MODEL if summary else "", "content_hash": hashlib.sha256(f"{identifier}:{file_uri}:{byte_offset}:{byte_length}:{digest}".encode()).hexdigest()}
        rows = conform(self.spark.createDataFrame([tuple(row.get(n) for n, _, _ in MEMORY)], ddl(MEMORY)))
        made = rows.select(*self._event("memory.created", F.col("id"), F.col("namespace"), log.payload(rows)))
        self.store.upsert(rows, conform(made, EVENT))
        return row["id"]

    def promote(self, memory_id: str, to_state: str, reason: str = "", actor: str = "") -> None:
        old = self.get(memory_id)
        lifecycle.check(memory_id, old["promotion_state"], to_state)
        self._update(old, {"promotion_state": to_state}, "memory.promotion", {"from": old["promotion_state"], "to": to_state, "reason": reason, "actor": actor})

    def mark_candidate(self, memory_id: str, candidate: bool = True, reason: str = "") -> None:
        self._update(self.get(memory_id), {"promotion_candidate": int(candidate)}, "memory.candidate", {"candidate": candidate, "reason": reason})

    def candidates(self, namespace: str | None = None, state: str | None = None) -> DataFrame:
        return lists.candidates(self.store.memories(), namespace, state).orderBy("created_at", "id")

    def by_state(self, state: str, namespace: str | None = None) -> DataFrame:
        return lists.by_state(self.store.memories(), state, namespace).orderBy("created_at", "id")

    def states(self) -> DataFrame:
        return lifecycle.states(self.spark)

    def events(self, limit: int = 100, ascending: bool = True, **conditions) -> DataFrame:
        return log.page(self.store.events(limit, ascending, **conditions), limit, ascending)

    def replay(self, after_seq: int = 0):
        """Events after a cursor in order of seq, one at a time."""
        for _, rows in self.store.slices(after_seq):
            yield from rows.orderBy("seq").toLocalIterator()

    def trim_events(self, keep: int) -> None:
        self.store.trim_events(keep)

    def replay_into(self, target: MemoryStore, after_seq: int = 0) -> int:
        return target.store.insert_ignore(log.created_rows(self.store.events(after_seq=after_seq), after_seq))

    # files

    def snapshot(self, path: str, copy_attachments: bool = False) -> dict | None:
        """A snapshot folder, or JSON lines if the path ends in .jsonl or .jsonl.gz."""
        if path.endswith((".jsonl", ".jsonl.gz")):
            return swap.write(self.store.memories(), path, compressed=path.endswith(".gz"))
        return snapshot.write(self.store.memories(), path, copy_attachments, self.base)

    def restore(self, path: str) -> int:
        rows = snapshot.load(self.spark, path)
        try:
            loaded = self.store.insert_ignore(swap.new_rows(rows, self.store.current()))
        except (Py4JJavaError, PySparkException) as error:
            if path.endswith(".gz") and any(told in str(error) for told in ("not a gzip file", "EOFException", "ZipException", "invalid gzip", "incorrect header check", "invalid block type", "invalid distance")):
                raise ValueError(f"malformed compressed swap file: {path}") from error
            raise
        kind = "bundle.imported" if os.path.isdir(path) and bundle.is_bundle(path) else "snapshot.imported"
        self._log(kind, {"path": path, "loaded": loaded})
        return loaded

    def import_history(self, path: str, source: str = "audit") -> int:
        kept = log.audit_replay(sqlite.read_history(self.spark, path))
        rows = kept.select(F.col("memory_id").alias("id"), "identifier", "fact_text", "created_at", F.lit(source).alias("source"), F.sha2(F.concat("identifier", F.lit(":"), "fact_text"), 256).alias("content_hash"), F.lit(None).cast("string").alias("embedding_b64"), F.lit(None).cast("int").alias("embedding_dim"), F.lit(None).cast("string").alias("embedding_model"))
        return self.store.insert_ignore(conform(swap.with_vectors(rows)))

    def discover(self, root: str, max_depth: int = 10) -> DataFrame:
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        found = bundle.index(self.spark, root, max_depth)
        self.store.append(bundles=found, events=self._notice("bundle.discovered", {"root": root, "count": found.count()}))
        return found

    def bundles(self) -> DataFrame:
        return self.store.bundles()

    def clear_bundles(self) -> None:
        self.store.clear_bundles()

    def inspect(self, uri: str, count_rows: bool = False, sample: int = 5) -> dict:
        return inspectors.inspect(self.spark, uri, count_rows, sample)

    def hygiene(self, listing: DataFrame | None = None) -> DataFrame:
        """Warnings; files are looked up in a listing (path, length), or where they are. It changes nothing."""
        rows = self.store.memories()
        listing = storage.listing(rows, self.base) if listing is None else listing
        missing = lists.files_missing(rows, listing, self.base or "").where("missing").select("id", (~F.col("uri").rlike("^(?!file)[a-z0-9]+://")).alias("checkable"))
        indexed = self.store.bundles()
        return hygiene.warnings(rows, missing, bundle.stale(indexed, storage.present(indexed.select("path"))), self.store.stats())

    def _update(self, old: dict, changes: dict, kind: str, told: dict) -> None:
        stamp = self._stamp()
        row = {"id": old["id"], "updated_at": stamp} | changes
        update = self.spark.createDataFrame([(row["id"], row.get("promotion_state"), row.get("promotion_candidate"), stamp)], "id string, promotion_state string, promotion_candidate int, updated_at string")
        event = update.select(*self._event(kind, F.col("id"), F.lit(old["namespace"]), F.lit(json.dumps(told, sort_keys=True))))
        self.store.append(updates=update, events=conform(event, EVENT))

    def _notice(self, kind: str, told: dict) -> DataFrame:
        one = self.spark.range(1).select(*self._event(kind, F.lit(None).cast("string"), F.lit(""), F.lit(json.dumps(told, sort_keys=True))))
        return conform(one, EVENT)

    def _log(self, kind: str, told: dict) -> None:
        self.store.append(events=self._notice(kind, told))

    def _event(self, kind: str, memory_id, namespace, payload) -> list:
        return [F.lit(uuid.uuid4().hex).alias("event_id"), memory_id.alias("memory_id"), namespace.alias("namespace"), F.lit(kind).alias("event_type"), F.lit(self._stamp()).alias("occurred_at"), payload.alias("payload_json")]

    @staticmethod
    def _now() -> int:
        return int(dt.datetime.now(dt.UTC).timestamp())

    @staticmethod
    def _stamp() -> str:
        return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
