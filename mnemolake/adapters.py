"""What agent frameworks ask of a memory, over the facade; no framework is imported."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from mnemolake.facade import MemoryStore
from mnemolake.operators.lists import CUES

#: Importance of a mirrored write by its target.
MIRRORED = {"user": 0.9, "memory": 0.8}


class ChatHistory:
    """The messages of a session in the order of time. Nothing is deleted, so clear() hides what is older than it."""

    def __init__(self, store: MemoryStore, session: str):
        self.store, self.session, self._hidden = store, session, 0

    def add(self, role: str, text: str) -> str:
        return self.store.add(self.session, text, source=f"chat:{role}", metadata_json=json.dumps({"role": role}))

    def messages(self, limit: int = 1000) -> list[tuple[str, str]]:
        rows = self.store.store.current().where((F.col("seq") > self._hidden) & (F.col("identifier") == self.session))
        return [(json.loads(r.metadata_json).get("role", "system"), r.fact_text) for r in rows.orderBy("seq").limit(limit).collect()]

    def clear(self) -> None:
        self._hidden = self.store.store.top_seq()


class Retriever:
    """Search results as (text, metadata)."""

    def __init__(self, store: MemoryStore, top_k: int = 5, max_chars: int | None = None):
        self.store, self.top_k, self.max_chars = store, top_k, max_chars

    def __call__(self, query: str) -> list[tuple[str, dict]]:
        found = self.store.search(query, self.top_k, self.max_chars).orderBy("rank").collect()
        return [(r.content, {"memory_id": r.memory_id, "identifier": r.identifier, "score": r.score, "source": "mnemolake"}) for r in found]


class AgentMemory:
    """Save and load, turns, mirrored writes, and facts kept before a context is cut."""

    def __init__(self, store: MemoryStore, agent: str = "agent"):
        self.store, self.agent = store, agent

    def save(self, text: str, importance: float = 0.5, **metadata) -> str:
        return self.store.add(self.agent, text, importance=importance, metadata_json=json.dumps(metadata))

    def load(self, query: str, top_k: int = 5) -> list[tuple[str, dict]]:
        return Retriever(self.store, top_k)(query)

    def context(self, query: str, top_k: int = 5) -> str:
        return self.store.context(query, top_k)

    def turn(self, user: str, assistant: str) -> None:
        self.store.add(f"{self.agent}:turn", f"User: {user}", importance=0.4, source="turn")
        self.store.add(f"{self.agent}:turn", f"Assistant: {assistant}", importance=0.3, source="turn")

    def mirror(self, action: str, target: str, text: str) -> str:
        """A write elsewhere: a replacement is an add; a removal makes the row expire, as nothing is deleted."""
        gone = {"ttl_seconds": 1} if action == "remove" else {}
        return self.store.add(f"{self.agent}:{target}", text, importance=MIRRORED.get(target, 0.5), source="memory_write", metadata_json=json.dumps({"action": action, "target": target}), **gone)

    def before_cut(self, texts: list[str], last: int = 6, chars: int = 1000) -> list[str]:
        return [self.store.add(f"{self.agent}:context", t[:chars], importance=0.6, source="pre_compress") for t in texts[-last:] if t and re.search(CUES, t)]

    def end(self, path: str) -> None:
        self.store.snapshot(path)
