"""Five tools over standard input and output: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import TextIO

from mnemolake.service import Service

_TEXT, _WHOLE = {"type": "string"}, {"type": "integer", "minimum": 1}


def _shape(required: tuple[str, ...] = (), **fields) -> dict:
    return {"type": "object", "properties": fields} | ({"required": list(required)} if required else {})


#: name: (what it does, its arguments, the request that it makes)
TOOLS = {
    "add_memory": ("Store a fact.", _shape(("identifier", "fact"), identifier=_TEXT, fact=_TEXT, importance={"type": "number", "minimum": 0, "maximum": 1}, ttl_seconds=_WHOLE), ("POST", "/v1/add")),
    "search_memories": ("Find the memories that fit a query best.", _shape(("query",), query=_TEXT, top_k=_WHOLE | {"maximum": 100}, max_chars=_WHOLE), ("POST", "/v1/search")),
    "memory_health": ("Tell how many memories there are, and where.", _shape(), ("GET", "/v1/health")),
    "snapshot": ("Write all memories to a file.", _shape(file=_TEXT), ("POST", "/v1/snapshot")),
    "hydrate": ("Load memories from a file.", _shape(file=_TEXT), ("POST", "/v1/hydrate")),
}


def answer(service: Service, message: dict) -> dict | None:
    """The reply to a message; None to a notification."""
    method, given = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "mnemolake", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": says, "inputSchema": shape} for n, (says, shape, _) in TOOLS.items()]}}
    if method == "tools/call" and given.get("name") in TOOLS:
        status, body = service.call(*TOOLS[given["name"]][2], given.get("arguments") or {})
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(body, default=str)}], "isError": status != 200}}
    return reply | {"error": {"code": -32602 if method == "tools/call" else -32601, "message": f"unknown: {given.get('name') if method == 'tools/call' else method}"}}


def run(service: Service, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(service, json.loads(line))
        except ValueError as error:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
