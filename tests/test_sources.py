"""Reads by runs of ranges, files of joined members, conditions that SQLite answers, and replay by stream and by cursor."""

import gzip
import hashlib
import json
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.operators import events
from mnemolake.schema import EVENT, HISTORY, conform, ddl
from mnemolake.sources import snapshot, sqlite, storage, swap
from mnemolake.store import Store
from mnemolake.streaming import event_stream


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(0, 5000)), max_size=30))
def test_runs_hold_their_ranges_in_order(ranges):
    ranges, at = sorted(ranges), 0
    for start, end, n in storage.runs(ranges):
        part = ranges[at : at + n]
        assert n and start == part[0][0] and end == max(o + k for o, k in part)
        assert all(o <= max(a + b for a, b in part[:i]) + storage.GAP for i, (o, _) in enumerate(part) if i)
        at += n
    assert at == len(ranges)


def test_a_task_opens_a_file_once(spark, tmp_path):
    path = tmp_path / "data.bin"
    data = random.Random(1).randbytes(2_000_000)
    path.write_bytes(data)
    rng, rows = random.Random(2), []
    for n in range(10_000):
        offset, length = rng.randrange(0, 1_999_000), rng.choice([0, 1, 50, 900])
        rows.append((f"r{n}", str(path), offset, length, hashlib.sha256(data[offset : offset + length]).hexdigest() if n % 3 else None))
    rows += [("short", str(path), 1_999_990, 50, None), ("wrong", str(path), 5, 9, "0" * 64), ("none", str(tmp_path / "absent"), 0, 1, None), ("far", "s3://b/k", 0, 1, None), ("null", None, 0, 1, None)]
    held = storage._Opened()
    plain = [dict(zip(("id", "source_uri", "byte_offset", "byte_length", "source_checksum"), r, strict=True)) for r in sorted(rows[:10_000], key=lambda r: r[2])]
    got = {i: (c, v, w) for i, c, v, w in storage.read_sorted(plain, held, None, True)}
    assert held.opened == 1 and len(got) == 10_000
    want = {i: (data[o : o + n], bool(s), None) for i, _, o, n, s in rows[:10_000]}
    assert got == want
    df = spark.createDataFrame(rows, "id string, source_uri string, byte_offset long, byte_length long, source_checksum string")
    read = {r.id: (None if r.content is None else bytes(r.content), r.verified, r.reason) for r in storage.read_references(df).collect()}
    assert {k: v for k, v in read.items() if k in want} == want
    assert {k: read[k][2] for k in ("short", "wrong", "none", "far", "null")} == {"short": "truncated", "wrong": "checksum_mismatch", "none": "missing_file", "far": "unsupported_scheme", "null": "missing_file"}


def test_further_schemes_are_opened_by_what_is_registered(spark):
    import io

    rows = spark.createDataFrame([("a", "mem://abc", 1, 2, None), ("b", "other://abc", 1, 2, None)], "id string, source_uri string, byte_offset long, byte_length long, source_checksum string")
    storage.register("mem", lambda uri: io.BytesIO(uri.partition("://")[2].encode()))
    try:
        assert {r.id: (r.content and bytes(r.content), r.reason) for r in storage.read_references(rows).collect()} == {"a": (b"bc", None), "b": (None, "unsupported_scheme")}
    finally:
        del storage.ADAPTERS["mem"]


@pytest.mark.parametrize("compressed", [True, False])
def test_an_export_is_one_file(spark, tmp_path, compressed):
    path = str(tmp_path / ("x.jsonl.gz" if compressed else "x.jsonl"))
    rows = conform(spark.range(3000).select(F.col("id").cast("string"), F.lit("i").alias("identifier"), F.concat(F.lit("é text "), "id").alias("fact_text"), F.md5(F.col("id").cast("string")).alias("content_hash")).repartition(5))
    for _ in range(2):  # the second time replaces
        swap.write(rows, path, compressed=compressed)
    with (gzip.open(path, "rt") if compressed else open(path)) as f:
        assert sorted(json.loads(line)["id"] for line in f) == sorted(map(str, range(3000)))
    back = swap.read(spark, path)
    assert sorted((r.id, r.fact_text) for r in back.collect()) == sorted((str(i), f"é text {i}") for i in range(3000))
    assert not compressed or len(swap.members_of(path)) == 5 == back.rdd.getNumPartitions()
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {path.rpartition("/")[2], *([path.rpartition("/")[2] + ".members"] if compressed else [])}
    if compressed:  # an index that doesn't fit is not used
        with open(path, "ab") as f:
            f.write(gzip.compress(b'{"id": "more", "identifier": "i", "fact_text": "t"}\n'))
        assert swap.read(spark, path).count() == 3001
    swap.write(rows.limit(0), path, compressed=compressed)
    assert swap.read(spark, path).count() == 0


def test_snapshots_copy_attachments_and_hold_every_reference(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "data.bin").write_bytes(data)
    rows = [(f"f{n:02d}", "file", "data.bin", 10 * n, 30 if n < 8 else 9000, f"h{n:02d}", "") for n in range(10)] + [("gone", "file", "absent", 0, 5, "", ""), ("a", "fact", "", None, None, "x1", "text"), ("b", "fact", "", None, None, None, "more"), ("same", "file", "data.bin", 0, 30, "h00x", "")]
    df = spark.createDataFrame(rows, "id string, memory_type string, source_uri string, byte_offset long, byte_length long, content_hash string, fact_text string").withColumn("identifier", F.lit("i"))
    out = str(tmp_path / "snap")
    told = snapshot.write(conform(df.repartition(3)), out, True, str(tmp_path))
    assert (told["memory_count"], told["inline_count"], told["file_backed_count"]) == (14, 2, 12) and snapshot.verify(out) == told
    assert told["snapshot_id"] == hashlib.sha256("".join(sorted(r[5] for r in rows if r[5])).encode()).hexdigest()
    with open(f"{out}/memories.jsonl") as f:
        assert [json.loads(line)["id"] for line in f] == sorted(r[0] for r in rows)
    held = {r["memory_id"]: r["attachment"] for r in told["file_backed_references"]}
    want = {r[0]: hashlib.sha256(data[r[3] : r[3] + r[4]]).hexdigest() if r[4] < 8192 and r[2] == "data.bin" else None for r in rows if r[1] == "file"}
    assert held == want and held["same"] == held["f00"] and len(told["attachments"]) == 8
    assert {p.name for p in (tmp_path / "snap" / "attachments").iterdir()} == {x for x in want.values() if x}
    assert sorted(r.id for r in snapshot.load(spark, out).collect()) == sorted(r[0] for r in rows)
    snapshot.write(conform(df.limit(0)), out)
    assert snapshot.verify(out)["memory_count"] == snapshot.load(spark, out).count() == 0


def test_sqlite_answers_conditions(spark, tmp_path):
    path = str(tmp_path / "m.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE memories (id TEXT COLLATE NOCASE, identifier TEXT, fact_text TEXT, embedding BLOB, created_at TEXT)")
    hostile = "x' OR 1=1 --"
    db.executemany("INSERT INTO memories VALUES (?, ?, 't', x'', ?)", [(f"k{n}", (hostile, "b", None)[n % 3], f"2024-01-{n % 28 + 1:02d}") for n in range(300)])
    db.commit()
    rows = sqlite.read_memories(spark, path)
    for test in (F.col("id") == "k7", F.col("id") == "K7", F.col("identifier") == hostile, F.col("identifier").isin("b", hostile), (F.col("created_at") >= "2024-01-05") & (F.col("created_at") < "2024-01-09"), (F.col("identifier") == "b") & (F.col("created_at") > "2024-01-20")):
        found = sqlite.read_memories(spark, path, test)
        want = spark.createDataFrame(rows.collect(), rows.schema).where(test)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
        assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows.where("length(id) = 2").count() == 10


def history(n, seed=5):
    rng = random.Random(seed)
    return [(str(i), rng.choice("xyz"), None, rng.choice([f"t{i}", " ", None]), rng.choice(["ADD", "UPDATE", "DELETE"]), f"2024-01-0{rng.randint(1, 9)}", None, rng.choice([0, 0, 1]), rng.choice([None, "bob"]), None) for i in range(n)]


def test_streamed_history_equals_the_whole(spark, tmp_path):
    rows, out, state = history(90), str(tmp_path / "log"), {}
    cuts = [0, 1, 30, 31, 70, 90]
    random.Random(3).shuffle(rows)

    def sink(batch, number):
        for r in batch.collect():
            state[r.memory_id] = None if r.gone else (r.identifier, r.fact_text, r.created_at)

    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], ddl(HISTORY)).coalesce(1).write.mode("append").parquet(out)
        stream = spark.readStream.schema(ddl(HISTORY)).parquet(out)
        event_stream.replay_history(stream, sink, str(tmp_path / "cp")).awaitTermination()
        whole = events.audit_replay(spark.createDataFrame(rows[:b], ddl(HISTORY)))
        assert {k: v for k, v in state.items() if v} == {r.memory_id: (r.identifier, r.fact_text, r.created_at) for r in whole.collect()}


def test_a_follower_goes_on_where_it_stopped(spark, tmp_path):
    store, got, cursor = Store(spark, str(tmp_path / "s")), [], str(tmp_path / "cursor")
    made = lambda a, b: conform(spark.createDataFrame([(f"e{n}", "memory.created") for n in range(a, b)], "event_id string, event_type string").repartition(2), EVENT)
    store.append(events=made(0, 50))
    store.append(events=made(50, 60))
    broken = []

    def sink(rows, last):
        if len(got) > 20 and not broken:
            broken.append(last)
            raise OSError("stopped")
        got.extend(r.event_id for r in rows.orderBy("seq").collect())

    with pytest.raises(OSError, match="stopped"):
        event_stream.follow(store, sink, cursor, 17)
    store.append(events=made(60, 75))
    event_stream.follow(store, sink, cursor, 17)
    assert got == [r.event_id for r in store.events().orderBy("seq").collect()] and len(got) == 75
    assert event_stream.follow(store, sink, cursor) == store._pointer()["events"][-1]["high"] and len(got) == 75
