"""The store over HTTP and as tools: JSON in, JSON out. Each call is one method of the facade.

Every result that is turned into JSON is bounded by its request (top_k, limit, the ids asked for) or is a listing that
its caller asked for as a whole. Writes take a lock, since a store has one writer.
"""

from __future__ import annotations

import base64
import json
import logging
import re
import threading
import time
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from mnemolake import trace
from mnemolake.facade import MemoryStore, NotFound
from mnemolake.operators import lists
from mnemolake.operators.lifecycle import STATES, STEPS, InvalidTransition
from mnemolake.sources import snapshot, storage

log = logging.getLogger(__name__)
#: Events that a hygiene check leaves in the log.
KEEP_EVENTS = 10_000
_METADATA = ("id", "identifier", "memory_type", "fact_text", "fact_summary", "embedding_dim", "embedding_model", "source", "importance", "content_hash", "source_uri", "byte_offset", "byte_length", "source_checksum", "source_format", "created_at")


class Refused(Exception):
    """A call that has an answer other than 200."""

    def __init__(self, status: int, error: str, **detail):
        super().__init__(error)
        self.status, self.body = status, {"error": error} | detail


def _parsed(text: str | None, default):
    try:
        return json.loads(text) if text else default
    except ValueError:
        return default


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _renamed(row: dict, *names: str) -> dict:
    return {"memory_id": row["id"]} | {n: row[n] for n in names}


def _number(value, name: str, low: int, high: int | None = None) -> int:
    try:
        n = int(value)
    except (TypeError, ValueError) as error:
        raise Refused(400, "bad_request", message=f"{name} must be a whole number") from error
    if n < low or high is not None and n > high:
        raise Refused(400, "bad_request", message=f"{name} is out of range")
    return n


class Service:
    def __init__(self, store: MemoryStore, swap_path: str = "swap.jsonl"):
        self.store, self.swap_path, self.began, self.writing = store, swap_path, time.time(), threading.RLock()

    # reading

    def health(self, _: dict) -> dict:
        return {"status": "ok", "memory_count": self.store.count(), "db_path": self.store.store.root, "uptime_s": round(time.time() - self.began, 1)}

    def search(self, asked: dict) -> dict:
        limit = asked.get("max_chars")
        found = self.store.search(asked["query"], _number(asked.get("top_k", 5), "top_k", 1, 100), None if limit is None else int(limit))
        return self._counted("memories", _rows(found.orderBy("rank").drop("rank")))

    def memories(self, asked: dict) -> dict:
        found = self.store.list(asked["identifier"], asked.get("order", "asc"), _number(asked.get("limit", 100), "limit", 1, 1000))
        return self._counted("memories", _rows(found.select("id", "identifier", "fact_text", "importance", "metadata_json", "source", "created_at")))

    def memory(self, asked: dict) -> dict:
        row = self.store.get(asked["memory_id"])
        return {n: row[n] for n in _METADATA} | {"metadata": _parsed(row["metadata_json"], {}), "provenance": _parsed(row["provenance_json"], None)}

    def hydrate_memory(self, asked: dict) -> dict:
        """A profile as JSON; without one, the raw content with its format and whether it was verified."""
        profile = asked.get("profile")
        found = self.store.hydrate(asked["memory_id"], profile, asked.get("verify", True))
        return found if profile is None else self._profile(found, profile)

    def hydrate_batch(self, asked: dict) -> dict:
        """One answer for each id, in order; what fails for one doesn't stop the others."""
        ids, profile = list(asked["memory_ids"]), asked.get("profile", "agent")
        try:
            found = self.store.hydrate_profiles(ids, profile, asked.get("verify", True))
        except ValueError as error:
            return self._counted("results", [{"memory_id": i, "error": "invalid_profile", "message": str(error)} for i in ids])
        results = []
        for memory_id in ids:
            if memory_id not in found:
                results.append({"memory_id": memory_id, "error": "not_found"})
            elif reason := found[memory_id].get("reason"):
                results.append({"memory_id": memory_id, "error": "provenance_mismatch", "reason": reason, "source_uri": memory_id})
            else:
                results.append(self._profile(dict(found[memory_id]), profile))
        return self._counted("results", results)

    def files(self, asked: dict) -> dict:
        rows = self.store.files(asked.get("identifier") or None)
        there = lists.files_missing(rows, storage.listing(rows, self.store.base), self.store.base or "").select("id", "file_bytes", "missing")
        shown = rows.select("id", "identifier", "source_uri", "byte_offset", "byte_length", "source_format", "source_checksum").join(there, "id").orderBy("id")
        out = [_renamed(r, "identifier", "source_uri", "byte_offset", "byte_length", "source_format", "source_checksum") | {"exists": not r["missing"], "size": r["byte_length"] if r["missing"] else r["file_bytes"]} for r in _rows(shown)]
        return self._counted("files", out)

    def bundles(self, _: dict) -> dict:
        return self._counted("bundles", _rows(self.store.bundles()))

    def events(self, asked: dict) -> dict:
        order, limit = asked.get("order", "asc"), _number(asked.get("limit", 100), "limit", 1, 1000)
        if order not in ("asc", "desc"):
            raise Refused(400, "bad_request", message="order is asc or desc")
        conditions = {k: asked[k] for k in ("memory_id", "namespace", "event_type", "since", "until") if asked.get(k) is not None}
        conditions |= {k: _number(asked[k], k, 0) for k in ("after_seq", "before_seq") if asked.get(k) is not None}
        rows = [{k: v for k, v in r.items() if k != "payload_json"} | {"payload": _parsed(r["payload_json"], {})} for r in _rows(self.store.events(limit, order == "asc", **conditions))]
        return self._counted("events", rows) | {"next_seq": rows[-1]["seq"] if rows else None}

    def candidates(self, asked: dict) -> dict:
        names = ("identifier", "namespace", "promotion_state", "memory_type", "created_at")
        return self._counted("candidates", [_renamed(r, *names) for r in _rows(self.store.candidates(asked.get("namespace"), asked.get("state")).select("id", *names))])

    def by_state(self, asked: dict) -> dict:
        names = ("identifier", "namespace", "promotion_state", "promotion_candidate", "memory_type", "created_at", "updated_at")
        rows = _rows(self.store.by_state(asked["state"], asked.get("namespace")).select("id", *names))
        return self._counted("memories", [_renamed(r, *names) | {"promotion_candidate": bool(r["promotion_candidate"])} for r in rows])

    def states(self, _: dict) -> dict:
        return {"states": list(STATES), "transitions": {a: [b for x, b in STEPS if x == a] for a in STATES}}

    # writing

    def add(self, asked: dict) -> dict:
        known = ("identifier", "fact", "file_uri", "byte_offset", "byte_length", "source_format", "source_checksum", "summary", "source", "importance", "ttl_seconds")
        given = {k: asked[k] for k in known if asked.get(k) is not None}
        try:
            with self.writing:
                memory_id = self.store.add(given.pop("identifier"), metadata_json=json.dumps(asked.get("metadata") or {}), **given)
        except storage.UnsupportedScheme as error:
            raise Refused(400, "unsupported_scheme", scheme=str(error).partition("://")[0], message="only local files can back a memory") from error
        except FileNotFoundError as error:
            raise Refused(400, "backing_file_not_found", source_uri=asked["file_uri"], message=str(error)) from error
        return {"memory_id": memory_id, "content_hash": self.store.get(memory_id)["content_hash"]}

    def promote(self, asked: dict) -> dict:
        with self.writing:
            old = self.store.get(asked["memory_id"])["promotion_state"]
            self.store.promote(asked["memory_id"], asked["to_state"], asked.get("reason") or "", asked.get("actor") or "")
        return {"memory_id": asked["memory_id"], "from_state": old, "to_state": asked["to_state"]}

    def mark(self, asked: dict) -> dict:
        with self.writing:
            self.store.mark_candidate(asked["memory_id"], bool(asked.get("candidate", True)), asked.get("reason") or "")
        return {"memory_id": asked["memory_id"], "promotion_candidate": bool(asked.get("candidate", True))}

    def restore(self, asked: dict) -> dict:
        path = asked.get("path") or asked.get("file") or self.swap_path
        with self.writing:
            total = snapshot.load(self.store.spark, path).count()
            loaded = self.store.restore(path)
        return {"loaded": loaded, "skipped_dupes": total - loaded, "path": path}

    def snapshot(self, asked: dict) -> dict:
        path = asked.get("path") or asked.get("file") or self.swap_path
        manifest = self.store.snapshot(path, bool(asked.get("copy_attachments")))
        return {"exported": manifest["memory_count"] if manifest else self.store.count(), "path": path}

    def discover(self, asked: dict) -> dict:
        try:
            with self.writing:
                found = _rows(self.store.discover(asked["root"], _number(asked.get("max_depth", 10), "max_depth", 0)).select("warning_count"))
        except FileNotFoundError as error:
            raise Refused(400, "root_not_found", message=str(error)) from error
        return {"discovered": len(found), "indexed": len(found), "warnings": sum(r["warning_count"] for r in found)}

    def hygiene(self, _: dict) -> dict:
        """Warnings and their counts. The check is told to the event log, which then keeps its last KEEP_EVENTS events."""
        found = _rows(self.store.hygiene())
        counts = {"warning_count": len(found)} | {f"{s}_count": sum(w["severity"] == s for w in found) for s in ("error", "warn", "info")}
        with self.writing:
            self.store._log("hygiene.checked", counts)
            for w in found:
                if w["severity"] == "error":
                    self.store._log("hygiene.warning", w)
            if self.store.store.event_count() > KEEP_EVENTS:
                self.store.trim_events(KEEP_EVENTS)
        return {"warnings": found, "count": len(found), "counts": counts}

    # how a call finds its method

    def call(self, method: str, path: str, asked: dict) -> tuple[int, dict]:
        """(status, answer) of a request; asked holds the query's or the body's values."""
        began, route = time.perf_counter(), next(((f, m) for verb, pattern, f in ROUTES if verb == method and (m := re.fullmatch(pattern, path))), None)
        try:
            if route is None:
                raise Refused(404, "unknown_path", path=path)
            answer = route[0](self, asked | route[1].groupdict())
            return 200, answer | ({} if "content" in answer and isinstance(answer["content"], bytes | bytearray) else {"trace_ms": round(1000 * (time.perf_counter() - began), 2)})
        except Refused as refused:
            return refused.status, refused.body
        except NotFound as missing:
            return 404, {"error": "not_found", "memory_id": missing.args[0]}
        except KeyError as missing:
            return 422, {"error": "missing_field", "field": missing.args[0]}
        except InvalidTransition as error:
            return 409, {"error": "invalid_transition", "memory_id": error.memory_id, "from_state": error.old, "to_state": error.new}
        except storage.ProvenanceError as error:
            return 409, {"error": "provenance_mismatch", "reason": error.reason, "source_uri": error.uri, "message": str(error)}
        except snapshot.SnapshotError as error:
            return 409, {"error": "snapshot_checksum_mismatch", "reason": error.reason, "file": error.file, "message": str(error)}
        except (ValueError, TypeError, OSError) as error:
            kind = "unsupported_scheme" if isinstance(error, storage.UnsupportedScheme) else "invalid_profile" if "profile" in str(error) else "bad_request"
            return 400, {"error": kind, "message": str(error)}

    @staticmethod
    def _counted(name: str, rows: list[dict]) -> dict:
        return {name: rows, "count": len(rows)}

    @staticmethod
    def _profile(found: dict, profile: str) -> dict:
        out = {"memory_id": found.pop("id"), "profile": profile} | {k: v for k, v in found.items() if v is not None}
        if "content" in out:
            raw = out["content"].encode() if isinstance(out["content"], str) else bytes(out["content"])
            out |= {"content": base64.b64encode(raw).decode(), "content_encoding": "base64"}
        if "provenance_json" in out:
            out["provenance"] = _parsed(out.pop("provenance_json"), None)
        if "warning" in out:
            out["warnings"] = [out.pop("warning")]
        return out


_ID = r"(?P<memory_id>[^/]+)"
ROUTES: list[tuple[str, str, Callable[[Service, dict], dict]]] = [
    ("GET", "/v1/health", Service.health), ("POST", "/v1/add", Service.add), ("POST", "/v1/search", Service.search), ("GET", "/v1/memories", Service.memories),
    ("POST", "/v1/memory/hydrate-batch", Service.hydrate_batch), ("GET", f"/v1/memory/{_ID}", Service.memory), ("POST", f"/v1/memory/{_ID}/hydrate", Service.hydrate_memory),
    ("POST", f"/v1/memory/{_ID}/promote", Service.promote), ("POST", f"/v1/memory/{_ID}/candidate", Service.mark), ("POST", "/v1/hydrate", Service.restore), ("POST", "/v1/snapshot", Service.snapshot),
    ("GET", "/v1/files", Service.files), ("GET", "/v1/bundles", Service.bundles), ("POST", "/v1/discover", Service.discover), ("GET", "/v1/hygiene", Service.hygiene), ("GET", "/v1/events", Service.events),
    ("GET", "/v1/promotion/candidates", Service.candidates), ("GET", "/v1/promotion/states", Service.states), ("GET", "/v1/promotion/by-state", Service.by_state),
]


def openapi() -> dict:
    """The routes as an OpenAPI document."""
    paths: dict[str, dict] = {}
    for verb, pattern, f in ROUTES:
        path = pattern.replace(_ID, "{memory_id}")
        named = [{"name": "memory_id", "in": "path", "required": True, "schema": {"type": "string"}}] if path != pattern else []
        paths.setdefault(path, {})[verb.lower()] = {"operationId": f.__name__, "summary": (f.__doc__ or f.__name__).splitlines()[0], "parameters": named, "responses": {"200": {"description": "the answer"}}}
    return {"openapi": "3.1.0", "info": {"title": "mnemolake", "version": "1"}, "paths": paths}


def http_server(service: Service, host: str = "127.0.0.1", port: int = 8787) -> ThreadingHTTPServer:
    """A server that is ready to run; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url, trace_id = urlsplit(self.path), uuid.uuid4().hex[:12]
            length = int(self.headers.get("Content-Length") or 0)
            try:
                asked = json.loads(self.rfile.read(length)) if length else {}
                if not isinstance(asked, dict):
                    raise ValueError("the body must be an object")
                with trace.timed("http.request", trace_id=trace_id, method=self.command, path=url.path) as told:
                    status, answer = service.call(self.command, url.path, dict(parse_qsl(url.query)) | asked)
                    told["status"] = status
            except ValueError as error:
                status, answer = 400, {"error": "bad_request", "message": str(error)}
            raw = status == 200 and isinstance(answer.get("content"), bytes | bytearray)
            data = bytes(answer["content"]) if raw else json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/octet-stream" if raw else "application/json")
            if raw:
                self.send_header("X-Provenance", "verified" if answer["verified"] else "unverified")
            self.send_header("X-Trace-Id", trace_id)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, form: str, *args) -> None:
            log.info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)
