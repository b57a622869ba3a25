import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from mnemolake import cli, tools
from mnemolake.adapters import AgentMemory, ChatHistory
from mnemolake.facade import MemoryStore
from mnemolake.service import ROUTES, Service, http_server, openapi


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("service")
    (base / "data.bin").write_bytes(b"0123456789")
    (base / "b").mkdir()
    (base / "b" / "memory.md").write_text("a bundle")
    return Service(MemoryStore(spark, str(base / "store"), base_dir=str(base)), str(base / "swap.jsonl"))


def test_traces_are_lines_of_json(capsys):
    from mnemolake import trace

    trace.to_stderr()
    with pytest.raises(KeyError), trace.timed("step", n=1) as told:
        told["rows"] = 2
        raise KeyError("x")
    got = json.loads(capsys.readouterr().err)
    assert got.pop("ms") >= 0 and got.pop("at") and got == {"event": "step", "n": 1, "rows": 2, "error": "KeyError"}
    trace.log.handlers.clear()


def test_calls(service):
    call = service.call
    status, made = call("POST", "/v1/add", {"identifier": "acme", "fact": "the invoice is late", "metadata": {"k": 1}})
    assert status == 200 and len(made["content_hash"]) == 64
    status, file = call("POST", "/v1/add", {"identifier": "acme", "file_uri": "data.bin", "byte_offset": 2, "byte_length": 3, "summary": "digits"})
    assert status == 200
    assert call("GET", "/v1/health", {})[1]["memory_count"] == 2
    found = call("POST", "/v1/search", {"query": "invoice", "top_k": 1})[1]
    assert found["count"] == 1 and found["memories"][0]["content"] == "the invoice is late" and "rank" not in found["memories"][0]
    assert call("GET", "/v1/memories", {"identifier": "acme", "order": "desc"})[1]["count"] == 2
    assert call("GET", f"/v1/memory/{made['memory_id']}", {})[1]["metadata"] == {"k": 1}
    raw = call("POST", f"/v1/memory/{file['memory_id']}/hydrate", {})[1]
    assert bytes(raw["content"]) == b"234" and raw["verified"]
    audit = call("POST", f"/v1/memory/{file['memory_id']}/hydrate", {"profile": "audit"})[1]
    assert audit["content"] == "MjM0" and audit["memory_id"] == file["memory_id"]
    batch = call("POST", "/v1/memory/hydrate-batch", {"memory_ids": [made["memory_id"], "none"], "profile": "agent"})[1]["results"]
    assert [r.get("error") for r in batch] == [None, "not_found"]
    files = call("GET", "/v1/files", {"identifier": "acme"})[1]["files"]
    assert [(f["exists"], f["size"]) for f in files] == [(True, 10)]
    assert call("POST", "/v1/discover", {"root": service.store.base})[1]["discovered"] == 1
    assert call("GET", "/v1/bundles", {})[1]["count"] == 1
    assert call("POST", f"/v1/memory/{made['memory_id']}/promote", {"to_state": "READY"})[1]["from_state"] == "HOT"
    assert call("POST", f"/v1/memory/{made['memory_id']}/candidate", {"candidate": True})[0] == 200
    assert call("GET", "/v1/promotion/candidates", {})[1]["count"] == 1 == call("GET", "/v1/promotion/by-state", {"state": "READY"})[1]["count"]
    assert call("GET", "/v1/promotion/states", {})[1]["transitions"]["HOT"] == ["READY"]
    assert call("GET", "/v1/hygiene", {})[1]["counts"]["error_count"] == 0
    page = call("GET", "/v1/events", {"limit": "2"})[1]
    assert page["count"] == 2 and call("GET", "/v1/events", {"after_seq": str(page["next_seq"])})[1]["events"][0]["event_type"] == "bundle.discovered"
    assert call("POST", "/v1/snapshot", {})[1]["exported"] == 2
    assert call("POST", "/v1/hydrate", {})[1]["loaded"] == 0


def test_refusals(service):
    for method, path, asked, status, error in (
        ("GET", "/v1/memory/none", {}, 404, "not_found"),
        ("GET", "/v1/nowhere", {}, 404, "unknown_path"),
        ("POST", "/v1/search", {}, 422, "missing_field"),
        ("POST", "/v1/search", {"query": "x", "top_k": 101}, 400, "bad_request"),
        ("POST", "/v1/add", {"identifier": "i", "file_uri": "s3://x/y", "byte_offset": 0, "byte_length": 1}, 400, "unsupported_scheme"),
        ("POST", "/v1/add", {"identifier": "i", "file_uri": "gone.bin", "byte_offset": 0, "byte_length": 1}, 400, "backing_file_not_found"),
        ("POST", "/v1/discover", {"root": "/nowhere"}, 400, "root_not_found"),
        ("GET", "/v1/events", {"order": "up"}, 400, "bad_request"),
    ):
        got, body = service.call(method, path, asked)
        assert (got, body["error"]) == (status, error), path
    made = service.call("POST", "/v1/add", {"identifier": "i", "fact": "state"})[1]["memory_id"]
    assert service.call("POST", f"/v1/memory/{made}/promote", {"to_state": "ARCHIVED"})[0] == 409
    assert service.call("POST", f"/v1/memory/{made}/hydrate", {"profile": "odd"})[1]["error"] == "invalid_profile"


def test_http(service):
    server = http_server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{at}/v1/health") as r:
            assert r.headers["X-Trace-Id"] and json.load(r)["status"] == "ok"
        with pytest.raises(urllib.error.HTTPError, match="404"):
            urllib.request.urlopen(f"{at}/v1/memory/none")
        made = json.load(urllib.request.urlopen(f"{at}/v1/add", json.dumps({"identifier": "web", "fact": "from the web"}).encode()))
        with urllib.request.urlopen(f"{at}/v1/memory/{made['memory_id']}/hydrate", b"") as r:
            assert r.read() == b"from the web" and r.headers["X-Provenance"] == "unverified"
    finally:
        server.shutdown()
        server.server_close()
    assert sum(len(x) for x in openapi()["paths"].values()) == len(ROUTES) == 19


def test_tools(service):
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "memory_health"}}, {"id": 4, "method": "tools/call", "params": {"name": "add_memory"}}, {"id": 5, "method": "odd"}]
    out = io.StringIO()
    tools.run(service, [*map(json.dumps, asked), "{"], out)
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [t.get("id") for t in told] == [1, 2, 3, 4, 5, None]
    assert len(told[1]["result"]["tools"]) == 5 and not told[2]["result"]["isError"] and told[3]["result"]["isError"] and told[4]["error"]["code"] == -32601


def test_cli_and_adapters(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "m")]
    assert cli.main([*at, "status"], spark) == 0 and json.loads(capsys.readouterr().out)["memory_count"] == 0
    store = MemoryStore(spark, str(tmp_path / "m" / "store"))
    chat, agent = ChatHistory(store, "s1"), AgentMemory(store)
    chat.add("human", "hello")
    chat.add("ai", "good day")
    assert chat.messages() == [("human", "hello"), ("ai", "good day")]
    chat.clear()
    chat.add("human", "again")
    assert chat.messages() == [("human", "again")]
    agent.mirror("add", "user", "likes green tea")
    assert len(agent.before_cut(["x", "please remember that tea is green"])) == 1
    assert agent.load("green tea", 1)[0][0] == "likes green tea"
    assert cli.main([*at, "search", "tea", "--top-k", "1"], spark) == 0 and json.loads(capsys.readouterr().out)["count"] == 1
    assert cli.main([*at, "promote", "none", "READY"], spark) == 1
