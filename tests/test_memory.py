import json
import os
import random
import sqlite3

import pytest

from mnemolake.facade import MemoryStore, NotFound
from mnemolake.functions.embed import bucket_sums, embed, embedding_buckets
from mnemolake.functions.stem import stem
from mnemolake.operators import dedup, events, search
from mnemolake.operators.lifecycle import InvalidTransition
from mnemolake.schema import conform
from mnemolake.sources import bundle, inspectors, snapshot, storage, swap

CORPUS = ["invoice invoices total was five", "Invoicing vendor_x duplicate invoice risk", "payment terms are net 30", "", "café résumé running runs", "the payment of the invoice is late", "running shoes"]


def test_embedding_anchors(spark):
    want = {"": {62: 1}, "a": {33: 1}, "Invoice": {23: 1, 37: -1, 49: -1, 57: -1, 58: 1}, "café": {34: 1, 62: 1}}
    for text, buckets in want.items():
        assert {i: v for i, v in enumerate(bucket_sums(text)) if v} == buckets
    df = spark.createDataFrame(list(enumerate(want)), "id int, t string")
    got = {}
    for r in embedding_buckets(df, "id", "t").collect():
        got.setdefault(list(want)[r.id], {})[r.bucket] = r.signed
    assert got == want
    assert abs(sum(v * v for v in embed("")) - 1) < 1e-9


@pytest.mark.parametrize("query", ["invoices", "payment inv", "run", "cafe", "vendor_x", "invoicing risk", "runni", "..."])
def test_bm25_equals_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(CORPUS, 1)))
    import re

    words = [w + "*" for w in re.findall(r"\w+", query.lower())]
    want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" ".join(words),))) if words else {}
    df = spark.createDataFrame(list(enumerate(CORPUS, 1)), "id int, fact_text string")
    got = {r.id: r.bm25 for r in search.bm25(search.index(df), query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_stems_equal_fts5():
    words = "relational conditional rational hopping hoping falling fizzed flies agreed plastered motoring sky happy generalization oscillators adjustable effective electricity formality sensibility controlling rate cease caresses ponies abilities".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for word in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (word,))
        assert db.execute("SELECT term FROM v").fetchone()[0] == stem(word), word


def test_live_versions_equal_replace(spark):
    rng = random.Random(3)
    for _ in range(3):
        ops = [(n, rng.choice("abcde"), rng.choice(["", "G", "H", "I", "J"])) for n in range(40)]
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE m (seq INTEGER, id TEXT PRIMARY KEY, h TEXT)")
        db.execute("CREATE UNIQUE INDEX u ON m(h) WHERE h != ''")
        db.executemany("INSERT OR REPLACE INTO m VALUES (?, ?, ?)", ops)
        want = sorted(db.execute("SELECT seq, id, h FROM m"))
        got = dedup.live_versions(spark.createDataFrame(ops, "seq long, id string, content_hash string"))
        assert sorted(map(tuple, got.select("seq", "id", "content_hash").collect())) == want


def test_insert_order_equals_insert_or_ignore(spark, tmp_path):
    rng = random.Random(11)
    for n in range(3):
        ops = [(i, rng.choice("abcdefgh"), rng.choice(["", "G", "H", "I", "J", "K"])) for i in range(50)] + [(90, "x", "h1"), (91, "x", "h2"), (92, "y", "h2"), (93, "y", "h3"), (94, "z", "h3")]
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE m (seq INTEGER, id TEXT PRIMARY KEY, h TEXT)")
        db.execute("CREATE UNIQUE INDEX u ON m(h) WHERE h != ''")
        db.executemany("INSERT OR IGNORE INTO m VALUES (?, ?, ?)", ops)
        got = dedup.insert_order(spark.createDataFrame(ops, "seq long, id string, content_hash string"))
        assert sorted(map(tuple, got.select("seq", "id", "content_hash").collect())) == sorted(db.execute("SELECT seq, id, h FROM m"))
    assert dedup.insert_order(spark.createDataFrame([], "seq long, id string, content_hash string")).count() == 0
    store = MemoryStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("x", "h1", "first"), ("x", "h2", "second"), ("y", "h3", "third")], "id string, content_hash string, fact_text string").coalesce(1)
    assert store.store.insert_ignore(rows) == store.count() == 2 and store.get("x")["fact_text"] == "first"
    assert store.store.insert_ignore(rows) == 0 and store.store.insert_ignore(rows.limit(0)) == 0


def test_stamps_with_offsets_are_kept_in_utc(spark):
    stamps = ["2024-01-01T03:00:00+02:00", "2024-01-01T01:00:00Z", "2024-01-01T00:30:00.5-0030", "soon", None, "2024-01-01"]
    df = spark.createDataFrame([(x,) for x in stamps], "t string")
    want = ["2024-01-01T01:00:00Z", "2024-01-01T01:00:00Z", "2024-01-01T01:00:00Z", "soon", None, "2024-01-01"]
    assert [r[0] for r in df.select(events.utc(df.t)).collect()] == want
    assert [events.utc_text(x) for x in stamps if x] == [x for x in want if x]


def test_audit_replay_equals_fold(spark):
    rng = random.Random(5)
    rows = [(str(n), rng.choice("xyz"), rng.choice(["t%d" % n, " ", None]), rng.choice(["ADD", "UPDATE", "DELETE"]), f"2024-01-0{rng.randint(1, 9)}", rng.choice([0, 0, 1]), rng.choice([None, "bob"])) for n in range(120)]
    want = {}
    for n, key, text, kind, at, gone, actor in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        if kind == "DELETE" or gone:
            want.pop(key, None)
        elif text and text.strip():
            want[key] = (actor or "imported", text, at)
    df = spark.createDataFrame(rows, "id string, memory_id string, new_memory string, event string, created_at string, is_deleted int, actor_id string")
    assert {r.memory_id: (r.identifier, r.fact_text, r.created_at) for r in events.audit_replay(df).collect()} == want


def test_store_end_to_end(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "store"), base_dir=str(tmp_path))
    (tmp_path / "data.bin").write_bytes(bytes(range(256)) * 4)
    a = store.add("acme", "the invoice is late", importance=0.9)
    b = store.add("acme", file_uri="data.bin", byte_offset=10, byte_length=20, summary="binary invoice data")
    assert store.add("acme", "the invoice is late") != a and store.count() == 2
    assert store.hydrate(b)["content"] == (bytes(range(256)) * 4)[10:30] and store.hydrate(b)["verified"]
    assert [r.content for r in store.search("invoice", 5).collect()][0] == "the invoice is late"
    assert store.search("invoice", 5, max_chars=10).first().content == "the invoic"
    assert store.context("invoice").startswith("Relevant memories:\n- ")
    store.promote(b, "READY")
    with pytest.raises(InvalidTransition):
        store.promote(b, "ARCHIVED")
    store.mark_candidate(b)
    assert [r.id for r in store.candidates().collect()] == [b] and [r.id for r in store.by_state("READY").collect()] == [b]
    kinds = [r.event_type for r in store.events().collect()]
    assert kinds == ["memory.created"] * 3 + ["memory.promotion", "memory.candidate"]
    (tmp_path / "data.bin").write_bytes(b"short")
    with pytest.raises(storage.ProvenanceError, match="truncated"):
        store.hydrate(b)
    with pytest.raises(NotFound):
        store.get("nothing")
    with pytest.raises(storage.ProvenanceError, match="truncated"):
        store.hydrate_all([b, "nothing"])
    with pytest.raises(NotFound):
        store.hydrate_all(["nothing", b])
    assert [r.reason for r in store.hydrate_batch([b, "nothing"]).collect()] == ["truncated", "not_found"]
    out = str(tmp_path / "snap")
    manifest = store.snapshot(out)
    assert manifest["memory_count"] == 2 and snapshot.verify(out)["snapshot_id"] == manifest["snapshot_id"]
    other = MemoryStore(spark, str(tmp_path / "other"))
    assert other.restore(out) == 2 and other.restore(out) == 0
    store.snapshot(str(tmp_path / "swap.jsonl.gz"))
    third = MemoryStore(spark, str(tmp_path / "third"))
    assert third.restore(str(tmp_path / "swap.jsonl.gz")) == 2
    replayed = MemoryStore(spark, str(tmp_path / "fourth"))
    assert store.replay_into(replayed) == 2
    store.store.compact()
    assert store.count() == 2 and store.get(b)["promotion_state"] == "READY"
    store.trim_events(2)
    assert store.events().count() == 2
    with open(os.path.join(out, "memories.jsonl"), "a") as f:
        f.write("\n")
    with pytest.raises(snapshot.SnapshotError, match="mismatch"):
        snapshot.verify(out)


def test_search_reads_the_stems_that_the_store_wrote(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "store"))
    rows = conform(spark.createDataFrame([(str(n), "acme", f"{CORPUS[n % len(CORPUS)]} {n}", embed(str(n)), f"h{n}", "2024-01-01T00:00:00Z") for n in range(40)], "id string, identifier string, fact_text string, embedding array<float>, content_hash string, created_at string"))

    def found():
        plain = search.messages(search.hybrid(store.store.memories(), "running invoices", 8)).collect()
        assert store.search("running invoices", 8).orderBy("rank").collect() == sorted(plain, key=lambda r: r["rank"])
        assert "ArrowEvalPython" not in store.search("running invoices", 8)._jdf.queryExecution().toString()

    assert store.store.insert_ignore(rows) == 40
    found()
    store.add("acme", "running late with the invoices", content_hash="h0")
    found()
    store.store.compact()
    found()
    ids = conform(spark.createDataFrame([("", "x"), ("", "y")], "id string, fact_text string"))
    store.store.insert_ignore(ids)
    assert store.count() == store.store.current().select("id").distinct().count()


def test_bundles_and_inspectors(spark, tmp_path):
    root = tmp_path / "b"
    (root / "attachments").mkdir(parents=True)
    (root / "memory.md").write_text("body")
    (root / "metadata.json").write_text(json.dumps({"identifier": "x", "tags": ["t"]}))
    (root / "facts.json").write_text(json.dumps([{"fact": "one"}, {"identifier": "y", "fact_text": "two"}, 3]))
    (root / "events.jsonl").write_text('{"event": "e"}\nbad\n')
    (root / "attachments" / "n.txt").write_text("note")
    os.symlink("/etc/hostname", root / "attachments" / "out")
    found, warnings = bundle.parse(str(root))
    assert [(r["identifier"], r["fact_text"]) for r in found] == [("x", "body"), ("x", "one"), ("y", "two"), ("x", "e"), ("x:n.txt", "")]
    assert len(warnings) == 3
    assert bundle.index(spark, str(tmp_path)).first().attachment_count == 1
    assert MemoryStore(spark, str(tmp_path / "s")).restore(str(root)) == 5
    (tmp_path / "c.csv").write_text("id;vendor\n1;a\n2;b\n")
    told = inspectors.inspect(spark, str(tmp_path / "c.csv"), count_rows=True)
    assert (told["columns"], told["delimiter"], told["row_count"]) == (["id", "vendor"], ";", 2)
    (tmp_path / "j.jsonl").write_text('{"id": 1}\nbad\n{"name": 2}')
    told = inspectors.inspect(spark, str(tmp_path / "j.jsonl"))
    assert (told["columns"], told["row_count"], told["invalid"]) == (["id", "name"], 3, 1)
    assert (told["sample"], told["unsupported_reason"]) == ([{"id": 1}, {"name": 2}], "line 1 isn't JSON")
    (tmp_path / "p.parquet").write_bytes(b"no")
    assert inspectors.inspect(spark, str(tmp_path / "p.parquet"))["unsupported_reason"]
    assert inspectors.inspect(spark, "/root/testdata/sf0.001/nation.parquet")["row_count"] == 25
    with pytest.raises(storage.UnsupportedScheme):
        inspectors.inspect(spark, "s3://x/y.csv")


def test_inspectors_tell_places(spark, tmp_path):
    csv = tmp_path / "q.csv"
    csv.write_bytes(b'id,note\n1,"line one\nline two"\n\n2,simple\n3,last')
    told = inspectors.inspect(spark, str(csv), count_rows=True, sample=5)
    raw = csv.read_bytes()
    assert [raw[o : o + n].strip() for o, n in told["byte_ranges"]] == [b'1,"line one\nline two"', b"2,simple", b"3,last"]
    assert (told["row_count"], told["sample"][0]["note"], len(told["checksum"])) == (3, "line one\nline two", 64) and isinstance(told["mtime"], float)
    lines = [json.dumps({"id": n, "é": "x" * (n % 50)}, ensure_ascii=False) for n in range(4000)]
    lines[3500] = "{no"
    path = tmp_path / "many.jsonl"
    path.write_text("\n".join(lines[:2]) + "\n\n" + "\n".join(lines[2:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        told = inspectors.inspect(spark, str(path), sample=3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = path.read_bytes()
    assert [json.loads(raw[o : o + n]) for o, n in told["byte_ranges"]] == told["sample"] and len(told["sample"]) == 3
    assert (told["row_count"], told["invalid"], told["unsupported_reason"]) == (4000, 1, "line 3501 isn't JSON")
    assert storage.metadata("/etc/hostname")["format"] == "unknown" and storage.FORMATS[".jpg"] == "jpeg"
    assert storage.exists(str(path)) and not storage.exists("nothing", str(tmp_path))
    assert storage.mapped(str(path), 3, 10) == storage.read_range(str(path), 3, 10) and storage.mapped(str(path), len(raw) - 2, 10) == raw[-2:]


def test_a_broken_gzip_is_a_value_error(spark, tmp_path):
    import gzip

    store = MemoryStore(spark, str(tmp_path / "s"))
    whole = gzip.compress("\n".join(json.dumps({"id": str(n), "identifier": "i", "fact_text": f"{random.random()}"}) for n in range(500)).encode())
    (tmp_path / "cut.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "other.jsonl.gz").write_bytes(b"not compressed at all")
    for name in ("cut", "other"):
        with pytest.raises(ValueError, match="malformed compressed"):
            store.restore(str(tmp_path / f"{name}.jsonl.gz"))
    assert store.count() == 0
    (tmp_path / "whole.jsonl.gz").write_bytes(whole)
    assert store.restore(str(tmp_path / "whole.jsonl.gz")) == 500
    snapshot.register("half", lambda s, path: swap.read(s, path).where("CAST(id AS INT) < 250"))
    try:
        assert snapshot.load(spark, str(tmp_path / "whole.jsonl.gz"), kind="half").count() == 250
    finally:
        del snapshot.IMPORTERS["half"]


def test_sqlite_sources(spark, tmp_path):
    path = str(tmp_path / "m.db")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE memories (id TEXT, identifier TEXT, fact_text TEXT, embedding BLOB, "x""; DROP TABLE y" TEXT)')
    db.executemany("INSERT INTO memories VALUES (?, 'i', ?, x'', '')", [(str(n), f"fact {n % 4}") for n in range(10)])
    db.execute("CREATE TABLE history (id TEXT, memory_id TEXT, old_memory TEXT, new_memory TEXT, event TEXT, created_at TEXT, updated_at TEXT, is_deleted INTEGER, actor_id TEXT, role TEXT)")
    db.executemany("INSERT INTO history VALUES (?, ?, NULL, ?, ?, ?, NULL, 0, NULL, NULL)", [("1", "a", "x", "ADD", "2024-01-01"), ("2", "a", "y", "UPDATE", "2024-01-02"), ("3", "b", "z", "ADD", "2024-01-01"), ("4", "b", None, "DELETE", "2024-01-02")])
    db.commit()
    store = MemoryStore(spark, str(tmp_path / "s"))
    assert store.restore(path) == 10  # rows without a stored hash keep the empty hash
    assert store.import_history(path) == 1 and store.get("a")["fact_text"] == "y"


def test_stream_replay(spark, tmp_path):
    from mnemolake.schema import EVENT, conform
    from mnemolake.streaming import event_stream

    log = str(tmp_path / "log")
    made = [(n, f"e{n}", f"m{n}", "memory.created", "2024-01-01T00:00:00Z", json.dumps({"id": f"m{n}", "identifier": "i", "fact_text": "f", "content_hash": f"h{n % 3}"})) for n in range(1, 7)]
    conform(spark.createDataFrame(made, "seq long, event_id string, memory_id string, event_type string, occurred_at string, payload_json string"), EVENT).write.parquet(log)
    store = MemoryStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        event_stream.replay(event_stream.read_events(spark, log), lambda rows, n: store.store.insert_ignore(rows), str(tmp_path / "cp")).awaitTermination()
    assert store.count() == 3


def test_python_tasks_hold_few_rows_at_once():
    import pyarrow as pa

    from mnemolake.functions import embed, stem

    texts, vectors = pa.array(["some words"] * 5000), pa.array([[0.5] * 64] * 5000, pa.list_(pa.float32()))
    packed = pa.array([embed.pack([0.5] * 64)] * 5000)
    for run, given in ((embed._embed_batches, texts), (stem._stem_batches, texts), (embed._encode, vectors), (embed._decode, packed)):
        sizes = [len(x) for x in run(iter([given]))]
        assert sum(sizes) == 5000 and max(sizes) <= 512
