"""python -m mnemolake.cli --store PATH COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from pyspark.sql import SparkSession

from mnemolake import tools, trace
from mnemolake.facade import MemoryStore
from mnemolake.service import Service, http_server, openapi


def mount(path: str) -> dict:
    """Makes a local store folder with a manifest if there is none; an existing manifest stays."""
    os.makedirs(path, exist_ok=True)
    manifest = os.path.join(path, "mount.json")
    if not os.path.exists(manifest):
        with open(manifest, "w") as f:
            json.dump({"created_at": dt.datetime.now(dt.UTC).isoformat(), "mount_path": os.path.abspath(path)}, f, indent=2)
    return {"mount_path": os.path.abspath(path), "store": os.path.join(os.path.abspath(path), "store"), "swap_path": os.path.join(os.path.abspath(path), "swap.jsonl"), "manifest_path": os.path.abspath(manifest)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mnemolake")
    top.add_argument("--store", default="mnemolake-store", help="folder of the store, or the root of one on a cluster's file system")
    top.add_argument("--base", default=None, help="folder that relative file references lie under")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, says: str, *arguments: tuple) -> None:
        p = commands.add_parser(name, help=says)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)

    command("serve", "answer HTTP", ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8787}))
    command("tools", "answer JSON-RPC on standard input")
    command("status", "how many memories there are")
    command("search", "the best memories for a query", ("query", {}), ("--top-k", {"type": int, "default": 5}), ("--max-chars", {"type": int}))
    command("snapshot", "write all memories", ("path", {}), ("--copy-attachments", {"action": "store_true"}))
    command("hydrate", "load memories", ("path", {}))
    command("import", "load the audit history of another store", ("path", {}), ("--source", {"default": "audit"}))
    command("inspect", "what a file holds", ("uri", {}), ("--count-rows", {"action": "store_true"}), ("--sample", {"type": int, "default": 5}))
    command("promote", "move a memory one state forward", ("memory_id", {}), ("to_state", {}), ("--reason", {"default": ""}), ("--actor", {"default": "cli"}))
    command("candidates", "memories marked for promotion", ("--namespace", {}), ("--state", {}))
    command("openapi", "the HTTP routes")
    return top


def answer(service: Service, asked: argparse.Namespace) -> tuple[int, dict]:
    """(status, answer) of a command that ends."""
    given = {k: v for k, v in vars(asked).items() if v is not None}
    if asked.command == "import":
        return 200, {"loaded": service.store.import_history(asked.path, asked.source)}
    if asked.command == "inspect":
        return 200, service.store.inspect(asked.uri, asked.count_rows, asked.sample)
    method, path = {"status": ("GET", "/v1/health"), "search": ("POST", "/v1/search"), "snapshot": ("POST", "/v1/snapshot"), "hydrate": ("POST", "/v1/hydrate"), "candidates": ("GET", "/v1/promotion/candidates"), "promote": ("POST", f"/v1/memory/{given.get('memory_id')}/promote")}[asked.command]
    return service.call(method, path, given)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    if asked.command == "openapi":
        print(json.dumps(openapi(), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("mnemolake").getOrCreate()
    root, swap = asked.store, "swap.jsonl"
    if "://" not in root:
        places = mount(root)
        root, swap = places["store"], places["swap_path"]
    service = Service(MemoryStore(spark, root, asked.base), swap)
    if asked.command == "serve":
        trace.to_stderr()
        http_server(service, asked.host, asked.port).serve_forever()
    elif asked.command == "tools":
        tools.run(service, sys.stdin, sys.stdout)
    else:
        status, told = answer(service, asked)
        print(json.dumps(told, default=str, indent=2))
        return 0 if status == 200 else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
