"""The store: what its pointer, its index and its lookups give, against scans, and what they read for it."""

import json
import random
import re
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.facade import MemoryStore
from mnemolake.functions.embed import embed
from mnemolake.operators import dedup, events, hygiene, search
from mnemolake.schema import EVENT, MEMORY, conform
from mnemolake.store import FAN, Store

CORPUS = ["invoice invoices total was five", "Invoicing vendor_x duplicate invoice risk", "payment terms are net 30", "", "café résumé running runs", "the payment of the invoice is late", "running shoes vendor y", "vendor_xy and vendor x"]


def rows_read(df):
    """Rows that the scans of df's plan gave, by file pattern, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found, todo, seen = [], [plan], 0
    while todo:
        p = todo.pop()
        seen += 1
        name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            files = p.relation().location().rootPaths().mkString(",")
            found.append((files, p.metrics().apply("numOutputRows").value()))
        if hasattr(p, "plan") and name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name == "ReusedExchangeExec":
            continue
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def read_of(df, log):
    return sum(n for files, n in rows_read(df) if f"/{log}/" in files)


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", df._jdf.queryExecution().executedPlan().toString()))


def rows_of(spark, rows):
    """(id, hash, text, kind, bytes) as memory rows, in one partition so that order is order."""
    df = spark.createDataFrame(rows, "id string, content_hash string, fact_text string, memory_type string, byte_length long").coalesce(1)
    return conform(df.withColumns({"identifier": F.lit("i"), "created_at": F.lit("2024-01-01T00:00:00Z")}))


row = st.tuples(st.sampled_from(["a", "b", "c", "d", "e", "", None]), st.sampled_from(["", None, "G", "H", "I", "J"]), st.sampled_from(["", "one", "one two", "three words here " * 3, None]), st.sampled_from(["fact", "file"]), st.sampled_from([None, 5, 70]))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(row, min_size=1, max_size=5), min_size=1, max_size=4), compacted=st.integers(0, 4))
def test_upserts_equal_replacing(spark, tmp_path_factory, batches, compacted):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE m (id TEXT PRIMARY KEY, h TEXT NOT NULL, t TEXT, kind TEXT, n INTEGER)")
    db.execute("CREATE UNIQUE INDEX u ON m(h) WHERE h != ''")
    for i, batch in enumerate(batches):
        store.upsert(rows_of(spark, batch))
        db.executemany("INSERT OR REPLACE INTO m VALUES (?, ?, ?, ?, ?)", [(k, h or "", t or "", kind, n) for k, h, t, kind, n in batch])
        if i + 1 == compacted:
            store.compact()
    want = sorted(db.execute("SELECT id, h, t, kind, n FROM m"), key=str)
    now = store.memories()
    assert sorted(map(tuple, now.select("id", "content_hash", "fact_text", "memory_type", "byte_length").collect()), key=str) == want
    assert store.count() == len(want) and store.stats().first() == hygiene.stats(now).first()
    held = store.postings().collect()
    live = {r.seq: r.fact_text for r in store.current().collect()}
    tokens = {(s, t): text.split().count(t) for s, text in live.items() for t in text.split()}
    assert {(r.seq, r.term): r.tf for r in held} == {(s, search.phrases(t)[0][0]): n for (s, t), n in tokens.items()}


def test_many_keys_replace_as_few_do(spark, tmp_path):
    """More keys than are looked up by filters: by joins."""
    store, rng, rows = Store(spark, str(tmp_path / "s")), random.Random(8), []
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE m (id TEXT PRIMARY KEY, h TEXT NOT NULL)")
    db.execute("CREATE UNIQUE INDEX u ON m(h) WHERE h != ''")
    for n in (120, 5, 90):
        rows = [(rng.choice([*map(str, range(70)), None]), rng.choice(["", *(f"h{i}" for i in range(70))]), "t" * rng.randint(0, 30), "fact", None) for _ in range(n)]
        store.upsert(rows_of(spark, rows))
        db.executemany("INSERT OR REPLACE INTO m VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(map(tuple, store.current().select("id", "content_hash").collect()), key=str) == sorted(db.execute("SELECT id, h FROM m"), key=str)
    assert store.stats().first() == hygiene.stats(store.memories()).first()


def test_inserts_ignore_what_is_there(spark, tmp_path):
    store, db = Store(spark, str(tmp_path / "s")), sqlite3.connect(":memory:")
    db.execute("CREATE TABLE m (id TEXT PRIMARY KEY, h TEXT)")
    db.execute("CREATE UNIQUE INDEX u ON m(h) WHERE h != ''")
    rng = random.Random(4)
    for n in (30, 3, 120):
        batch = [(rng.choice([*map(str, range(60)), "", None]), rng.choice(["", None, *(f"h{i}" for i in range(60))]), f"text {i}", "fact", None) for i in range(n)]
        before = db.execute("SELECT count(*) FROM m").fetchone()[0]
        db.executemany("INSERT OR IGNORE INTO m VALUES (?, ?)", [(k, h or "") for k, h, *_ in batch])
        assert store.insert_ignore(rows_of(spark, batch)) == db.execute("SELECT count(*) FROM m").fetchone()[0] - before
    assert sorted(map(tuple, store.current().select("id", "content_hash").collect()), key=str) == sorted(db.execute("SELECT id, h FROM m"), key=str)


def test_rows_without_a_hash_are_imported(spark, tmp_path):
    path = str(tmp_path / "m.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE memories (id TEXT, identifier TEXT, fact_text TEXT, embedding BLOB, content_hash TEXT)")
    db.executemany("INSERT INTO memories VALUES (?, 'i', ?, x'', ?)", [("1", "one", None), ("2", "two", "h"), ("3", "three", ""), ("4", "four", None), ("5", "five", "h")])
    db.commit()
    store = MemoryStore(spark, str(tmp_path / "s"))
    assert store.restore(path) == 4 and store.get("1")["content_hash"] == ""
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "a"), (5, None)], "n int, content_hash string")
    assert sorted(r.n for r in dedup.first_by_hash(df, ["n"]).collect()) == [1, 2, 3, 5]
    assert sorted(r.n for r in dedup.merge(df.where("n = 1"), df.where("n > 1"), ["n"]).collect()) == [1, 2, 3, 5]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """20,000 rows in one batch of many row groups."""
    store = Store(spark, str(tmp_path_factory.mktemp("large")), row_group_bytes=1 << 16)
    n = F.col("n").cast("string")
    common = F.concat(F.lit("memory number "), n, F.lit(" of word"), (F.col("n") % 500).cast("string"), F.when(F.col("n") % 4000 == 0, " rarely running").otherwise(""))
    rows = spark.range(20_000).withColumnRenamed("id", "n").select(F.md5(n).alias("id"), F.lit("i").alias("identifier"), common.alias("fact_text"), F.sha2(n, 256).alias("content_hash"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    assert store.insert_ignore(conform(rows)) == 20_000
    return store


def test_lookups_skip_row_groups(spark, large):
    import hashlib

    known = hashlib.md5(b"77").hexdigest()
    found = large.current().where(F.col("id") == known)
    assert found.count() == 1 and read_of(found, "versions") < 1000
    digest = hashlib.sha256(b"77").hexdigest()
    found = large.current().where(F.col("content_hash") == digest)
    assert found.count() == 1 and read_of(found, "versions") < 1000
    keys = spark.createDataFrame([(f"new{i}", hashlib.sha256(str(i if i % 2 else -i - 1).encode()).hexdigest()) for i in range(4)], "id string, content_hash string")
    have = large._holding(large._pointer(), keys)
    assert sorted(r.content_hash for r in have.collect()) == sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in (1, 3))
    assert read_of(have, "versions") < 20_000 // 10
    none = large._holding(large._pointer(), keys.where("id = 'new0'"))
    assert none.count() == 0 and read_of(none, "versions") < 1000


def test_searches_read_the_postings_of_their_terms(large):
    found = large.bm25("rarely running")
    assert found.count() == 5 and read_of(found, "postings") < 4000  # of 100,000 and more
    assert large.bm25("absent").count() == 0 and read_of(large.bm25("absent"), "postings") < 4000
    assert large.bm25("...") is None


def test_upserts_read_little_and_current_shuffles_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, [(str(i), f"h{i}", "x" * i, "fact", None) for i in range(300)]))
    for i in range(4):
        store.upsert(rows_of(spark, [(str(i), f"h{i + 10}", "y", "fact", None)]))
    now = store.current()
    assert now.count() == 296 and shuffles(now) == 0
    assert store.stats().first() == hygiene.stats(store.memories()).first()
    store.upsert(rows_of(spark, [("299", "h299", "short", "fact", None)]))  # the largest dies
    assert store.stats().first().largest_inline == 298 == hygiene.stats(store.memories()).first().largest_inline
    assert store.stats()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 0


QUERIES = ["invoices", "payment inv", "run", "cafe", "vendor_x", "vendor_x inv", "invoicing risk", "runni", "..."]


def test_postings_equal_fts5(spark, tmp_path):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(CORPUS)))
    db.execute("DELETE FROM t WHERE rowid = 0")
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, [(str(i), f"h{i}", t, "fact", None) for i, t in enumerate(CORPUS[:4])]))
    store.upsert(rows_of(spark, [(str(i), f"h{i}", t, "fact", None) for i, t in enumerate(CORPUS) if i > 3]))
    store.upsert(rows_of(spark, [("0", "h5", CORPUS[5], "fact", None)]))  # replaces 0 by id and 5 by hash
    for _ in range(2):
        ids = {r.seq: int(r.id) for r in store.current().select("seq", "id").collect()}
        for query in QUERIES:
            words = [w + "*" for w in re.findall(r"\w+", query.lower())]
            want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" ".join(words),))) if words else {}
            scores = store.bm25(query)
            got = {5 if ids[r.seq] == 0 else ids[r.seq]: r.bm25 for r in scores.collect()} if scores is not None else {}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), query
        store.compact()


def test_levels_merge_one_level(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(FAN + 2):
        store.upsert(rows_of(spark, [(str(i % 6), f"h{i % 4}", f"text {i}", "fact", None)]))
    now, old = sorted(map(tuple, store.current().collect())), store._pointer()["versions"]
    terms = sorted(map(tuple, store.postings().collect()))
    assert store.compact_level() and not store.compact_level()
    new = store._pointer()["versions"]
    assert len(new) == 3 and new[1:] == old[FAN:]
    assert sorted(map(tuple, store.current().collect())) == now and sorted(map(tuple, store.postings().collect())) == terms
    assert store.stats().first() == hygiene.stats(store.memories()).first()
    store.upsert(rows_of(spark, [("0", "h9", "again", "fact", None)]))
    gone = store.vacuum()
    assert gone > 0 and store.count() == store.current().count() and store.vacuum() == 0


def event(n):
    return (f"e{n}", f"m{n}", ("memory.created", "memory.promotion")[n % 2], f"2024-01-{1 + n // 100:02d}T00:00:00Z", "{}")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """40 batches of 25 events, of several partitions each."""
    store = Store(spark, str(tmp_path_factory.mktemp("log")))
    for b in range(40):
        df = spark.createDataFrame([event(b * 25 + i) for i in range(25)], "event_id string, memory_id string, event_type string, occurred_at string, payload_json string")
        store.append(events=conform(df.repartition(3) if b % 2 else df, EVENT))
    return store


def files_of(df):
    return len({f.rpartition("/")[0] for f in df.inputFiles()})


def test_pages_open_the_batches_that_they_need(log):
    everything = log.events()
    assert log.event_count() == everything.count() == 1000
    seqs = sorted(r.seq for r in everything.select("seq").collect())
    for ascending in (True, False):
        for given in ({}, {"after_seq": seqs[600]}, {"before_seq": seqs[300]}, {"event_type": "memory.promotion", "after_seq": seqs[100]}, {"since": "2024-01-10T00:00:00Z"}, {"event_type": "absent"}, {"memory_id": "m7"}):
            few = log.events(20, ascending, **given)
            assert events.page(few, 20, ascending).collect() == events.page(everything, 20, ascending, **given).collect()
            if set(given) <= {"after_seq", "before_seq", "event_type"}:
                assert files_of(few) <= 4
    assert files_of(log.events(since="2024-01-10T00:00:00Z")) == 4


def test_slices_give_each_event_once_in_order(log):
    want = [r.seq for r in log.events().select("seq").orderBy("seq").collect()]
    for after, most in ((0, 170), (want[123], 300), (want[-1], 5), (want[-2], 5)):
        cursor, got = after, []
        for cursor, rows in log.slices(after, most):
            part = [r.seq for r in rows.select("seq").orderBy("seq").collect()]
            assert 0 < len(part) <= most and part[-1] == cursor
            got += part
        assert got == [s for s in want if s > after]
    first = next(log.slices(0, 60))
    assert files_of(first[1]) == 3


def test_trimming_writes_one_batch(spark, tmp_path, log):
    import shutil

    shutil.copytree(log.root, tmp_path / "copy")
    store = Store(spark, str(tmp_path / "copy"))
    before, want = {b["path"] for b in store._pointer()["events"]}, [r.seq for r in store.events().select("seq").orderBy("seq").collect()]
    store.trim_events(110)
    after = store._pointer()["events"]
    assert len(after) == 5 and len({b["path"] for b in after} - before) == 1
    assert [r.seq for r in store.events().select("seq").orderBy("seq").collect()] == want[-110:] and store.event_count() == 110
    store.compact_events()
    assert len(store._pointer()["events"]) == 1 and store.event_count() == 110
    assert [r.seq for r in store.events(event_type="memory.created").select("seq").orderBy("seq").collect()] == [r.seq for r in store.events().where("event_type = 'memory.created'").select("seq").orderBy("seq").collect()]
    store.trim_events(7)
    assert [r.seq for r in store.events().select("seq").orderBy("seq").collect()] == want[-7:]
    assert [r.seq for _, rows in store.slices(0, 3) for r in rows.orderBy("seq").collect()] == want[-7:]
    store.trim_events(0)
    assert store.event_count() == store.events().count() == 0
    with pytest.raises(ValueError):
        store.trim_events(-1)


def test_an_older_store_is_told(spark, tmp_path):
    (tmp_path / "pointer.json").write_text(json.dumps({"next": 1, "versions": []}))
    with pytest.raises(ValueError, match="older version"):
        Store(spark, str(tmp_path)).count()


def test_search_equals_the_search_without_an_index(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "store"))
    rows = conform(spark.createDataFrame([(str(n), "acme", f"{CORPUS[n % len(CORPUS)]} {n}", embed(str(n)), f"h{n}", "2024-01-01T00:00:00Z", ("HOT", "ARCHIVED")[n % 9 == 0]) for n in range(40)], "id string, identifier string, fact_text string, embedding array<float>, content_hash string, created_at string, promotion_state string"))
    assert store.store.insert_ignore(rows) == 40
    store.add("acme", "running late with the invoices", content_hash="h1")
    for query in ("running invoices", "vendor_x", "..."):
        plain = search.messages(search.hybrid(store.store.memories(), query, 8)).collect()
        found = store.search(query, 8)
        assert found.orderBy("rank").collect() == sorted(plain, key=lambda r: r["rank"])
        assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    assert {c for c, _, _ in MEMORY} == set(store.store.memories().columns)


def test_a_batch_of_many_bytes_is_several_files_in_order_of_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mnemolake.store.FILE_BYTES", 1 << 18, raising=False)
    rows = [(f"m{i:04d}", "i", f"word{i % 7} " + "many " * 60, f"h{i}") for i in range(1200)]
    store = Store(spark, str(tmp_path / "s"))
    assert store.insert_ignore(conform(spark.createDataFrame(rows, "id string, identifier string, fact_text string, content_hash string"))) == 1200
    for _ in range(2):
        read = spark.read.parquet(f"{store.root}/{store._pointer()['versions'][0]['path']}").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
        assert len(read) >= 2 and sum(r.n for r in read) == 1200 and max(r.n for r in read) <= 700
        assert all(a.high < b.low for a, b in zip(read, read[1:], strict=False))
        assert store.bm25("word3").count() == sum(i % 7 == 3 for i in range(1200))
        store.compact()


def test_many_replaced_versions_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mnemolake.store.BROADCAST_DEAD", 10)
    store = Store(spark, str(tmp_path / "s"))
    for k in range(2):
        store.upsert(conform(spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(f"text {k}").alias("fact_text"))))
    found = store.current()
    assert {r.fact_text for r in found.collect()} == {"text 1"} and found.count() == 200
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
