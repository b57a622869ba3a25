"""The registered queries: the driver's tables seen as memories (M), documents (D), events (E) and vectors (V)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.embed import decode_vector, embedding, embedding_buckets, encode_vector
from mnemolake.functions.exprs import agent_truncate, content_hash, file_hash, resolve_uri, stored_vector_ok, ttl_live
from mnemolake.operators import dedup, events, hydrate, hygiene, lifecycle, lists, search
from mnemolake.operators.vectors import VectorLists
from mnemolake.schema import DIM, EVENT, MODEL, conform
from mnemolake.sources import bundle, inspectors, swap
from mnemolake.store import Store
from mnemolake.streaming import event_stream
from mnemolake.work import shared_dir

#: 2024-01-01T02:00:00Z
NOW = 1704074400
QUERY, PHRASE, STEMMED, MEMORIES = "the and of then", "the_an of", "things and the", "the thing and then"
VECTOR = tuple(float((i * 7) % 13 - 6) for i in range(64))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(
        F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("identifier"),
        F.col("text").alias("fact_text"),
        F.col("role").alias("source"),
        (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(11)) / 10.0).alias("importance"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(F.pmod("conv_id", F.lit(5)) == 0, F.lit(3600)).cast("long").alias("ttl_seconds"),
        F.element_at(F.array(*(F.lit(s) for s in lifecycle.STATES)), (F.pmod("conv_id", F.lit(4)) + 1).cast("int")).alias("promotion_state"),
        (F.pmod("conv_id", F.lit(3)) == 0).cast("int").alias("promotion_candidate"),
        content_hash(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")), F.col("text")).alias("content_hash"),
    )


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("identifier"), F.col("text").alias("fact_text"), content_hash(F.col("source"), F.col("text")).alias("content_hash"), F.lit("fact").alias("memory_type"), F.lit(None).cast("long").alias("byte_length"), F.lit(None).cast("string").alias("fact_summary"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit(0.5).alias("importance"), F.lit("").alias("source_uri"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("memory_id"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(10)).cast("string")).alias("namespace"), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.col("props").alias("payload_json"), "value")


_STORES: dict[tuple, tuple] = {}


def _stored(spark: SparkSession, sf_dir: str, table: str, kind: str, write: Callable[[str], Any]) -> Any:
    """What write(folder) gives: a store that is derived from a table, written at its first use in a session and anew when the table has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    changed = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if _STORES.get(key, (None, None))[0] != changed:
        _STORES[key] = changed, write(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _STORES[key][1]


def memory_store(s, d, stemmed: bool = True) -> Store:
    def write(at: str) -> Store:
        store = Store(s, at, stemmed)
        store.insert_ignore(conform(memories(s, d).withColumn("embedding", embedding(F.col("fact_text")))))
        return store

    return _stored(s, d, "conversations", "memories" if stemmed else "plain-memories", write)


def version_store(s, d) -> Store:
    """Events as versions, upserted in three batches: by id and by hash, later ones replace earlier ones."""

    def write(at: str) -> Store:
        store, e = Store(s, at), event_rows(s, d)
        kind = F.when(F.col("event_type") == "click", "file").otherwise("fact")
        rows = e.select("seq", F.col("memory_id").alias("id"), F.when(F.col("event_type") == "view", F.sha2("payload_json", 256)).otherwise("").alias("content_hash"), F.col("payload_json").alias("fact_text"), kind.alias("memory_type"), (F.col("seq") % 100).alias("byte_length"), F.col("seq").cast("string").alias("source"))
        third = e.agg(F.max("seq")).first()[0] // 3 + 1
        for n in range(3):
            store.upsert(rows.where((F.col("seq") >= n * third) & (F.col("seq") < (n + 1) * third)).orderBy("seq").drop("seq"))
        return store

    return _stored(s, d, "events", "versions", write)


def event_store(s, d) -> Store:
    """Events in four batches, of which the newest seven tenths stay."""

    def write(at: str) -> Store:
        store, e = Store(s, at), event_rows(s, d).withColumn("event_id", F.col("seq").cast("string"))
        quarter = e.agg(F.max("seq")).first()[0] // 4 + 1
        for n in range(4):
            store.append(events=conform(e.where((F.col("seq") >= n * quarter) & (F.col("seq") < (n + 1) * quarter)).orderBy("seq"), EVENT))
        store.trim_events(store.event_count() * 7 // 10)
        return store

    return _stored(s, d, "events", "events", write)


def q_content_hash(s, d):
    return memories(s, d).select("id", "content_hash")


def q_ttl_live(s, d):
    return memories(s, d).where(ttl_live(NOW)).select("id", "created_at")


def q_archived_filter(s, d):
    return search.visible(memories(s, d), None).select("id", "promotion_state")


def q_by_state(s, d):
    return lists.by_state(memories(s, d), "READY").select("id", "identifier", "created_at")


def q_candidates(s, d):
    return lists.candidates(memories(s, d), state="HOT").select("id", "identifier", "promotion_state")


def q_list_by_identifier(s, d):
    return lists.by_identifier(memories(s, d), "conv_6", NOW, ascending=False, limit=3).select("id", "identifier", "fact_text", "created_at")


def q_memory_count(s, d):
    return memories(s, d).agg(F.count("*").alias("n"))


def q_counts_by_type(s, d):
    rows = memories(s, d).withColumn("memory_type", F.when(F.col("source") == "system", "file").otherwise("fact"))
    return lists.counts_by_type(rows)


def q_point_lookup(s, d):
    return lists.by_id(memories(s, d), "cfcd208495d565ef66e7dff9f98764da").unionByName(lists.by_identifier(memories(s, d), "conv_1", NOW)).select("id", "fact_text")


def q_content_hashes(s, d):
    return lists.content_hashes(doc_rows(s, d))


def q_conform(s, d):
    return conform(_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("identifier"))).select("id", "identifier", "fact_text", "importance", "tier", "promotion_state", "promotion_candidate", "tags", "schema_version")


def q_hash_embedding_buckets(s, d):
    return embedding_buckets(memories(s, d), "id", "fact_text")


def q_embedding(s, d):
    vectors = memories(s, d).select("id", embedding(F.col("fact_text")).alias("v"))
    return vectors.select("id", F.posexplode("v").alias("bucket", "x")).where("x != 0").select("id", F.col("bucket").cast("int").alias("bucket"), F.round(F.col("x").cast("double"), 5).alias("x"))


def q_cosine_topk(s, d):
    top = search.cosine_topk(_table(s, d, "embeddings"), list(VECTOR), 10, "vec_id")
    return top.select("vec_id", F.round("cosine", 6).alias("cosine"))


def q_cosine_lists(s, d):
    """The same over lists of vectors, most of which a bound rules out."""
    write = lambda at: VectorLists.write(_table(s, d, "embeddings"), at, "vec_id", "embedding")
    return _stored(s, d, "embeddings", "vectors", write).search(list(VECTOR), 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


def _bm25(s, d):
    return search.bm25(search.index(memories(s, d), stemmed=False), QUERY, stemmed=False)


def q_bm25_prefix(s, d):
    return _bm25(s, d).select("id", F.round("bm25", 6).alias("bm25"))


def q_bm25_norm(s, d):
    return search.normalised(_bm25(s, d)).select("id", F.round("text_score", 6).alias("text_score"))


def _of_index(store: Store, query: str) -> DataFrame:
    return store.bm25(query).join(store.current().select("seq", "id"), "seq").select("id", "bm25")


def q_bm25_stemmed(s, d):
    """Over the written index: reads the postings of three terms."""
    return _of_index(memory_store(s, d), STEMMED).select("id", F.round("bm25", 6).alias("bm25"))


def q_bm25_postings(s, d):
    return _of_index(memory_store(s, d, stemmed=False), QUERY).select("id", F.round("bm25", 6).alias("bm25"))


def q_bm25_phrase(s, d):
    """An underscore makes a phrase of two tokens."""
    return _of_index(memory_store(s, d, stemmed=False), PHRASE).select("id", F.round("bm25", 6).alias("bm25"))


def _hybrid(s, d, k=20):
    rows = memories(s, d).withColumn("fact_summary", F.lit(None).cast("string")).join(_table(s, d, "embeddings").select(F.col("vec_id"), "embedding"), F.col("vec_id") == F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("long"), F.lit(_table(s, d, "embeddings").count())))
    return search.hybrid(rows, QUERY, k, NOW, stemmed=False, query_vector=list(VECTOR))


def q_hybrid_search(s, d):
    return _hybrid(s, d).select("id", "identifier", "rank", F.round("score", 6).alias("score"))


def q_hybrid_memories(s, d):
    store = memory_store(s, d)
    found = search.messages(search.hybrid_of_scores(store.current(), store.bm25(MEMORIES), MEMORIES, 10, NOW))
    return found.select("role", "content", "memory_id", "identifier", "score", "created_at", "rank")


def q_hybrid_postings(s, d):
    store = memory_store(s, d, stemmed=False)
    return search.hybrid_of_scores(store.current(), store.bm25(QUERY), QUERY, 20, NOW).select("id", "rank", F.round("score", 6).alias("score"))


def q_store_versions(s, d):
    return version_store(s, d).current().select("id", "content_hash", "fact_text", F.col("source").cast("long").alias("event_id"))


def q_store_stats(s, d):
    """From the pointer alone, after many rows were replaced."""
    return version_store(s, d).stats()


def _keys(s, d) -> DataFrame:
    """An id and a hash for each item; a few of them are filters, more are joined."""
    item = F.col("item_id").cast("string")
    return _table(s, d, "benchmark").select(item.alias("id"), F.sha2(F.concat(F.lit('{"k": '), item, F.lit("}")), 256).alias("content_hash"))


def q_store_lookup(s, d):
    """The ids and hashes of a table, looked up in the store."""
    return version_store(s, d).holding(_keys(s, d)).select("id", "content_hash", F.col("source").cast("long").alias("event_id"))


def q_event_log_trimmed(s, d):
    return event_store(s, d).events(event_type="purchase", since="2024-01-02T00:00:00Z").select(F.col("event_id").cast("long").alias("event_id"), "memory_id", "occurred_at")


def q_event_slices(s, d):
    """A running log in slices of bounded size, by cursor."""
    store = event_store(s, d)
    slices = [rows.agg(F.lit(n).alias("slice"), F.count("*").alias("n"), F.min(F.col("event_id").cast("long")).alias("first"), F.max(F.col("event_id").cast("long")).alias("last")) for n, (_, rows) in enumerate(store.slices(0, -(-store.event_count() // 7)))]
    return reduce(DataFrame.unionByName, slices)


def q_swap_round_trip(s, d):
    """Memories exported as one compressed file of JSON lines, and read back by its members."""

    def write(at: str) -> str:
        rows = conform(memories(s, d).withColumn("embedding", embedding(F.col("fact_text"))))
        swap.write(rows, f"{at}.jsonl.gz", compressed=True)
        return f"{at}.jsonl.gz"

    back = swap.with_vectors(swap.read(s, _stored(s, d, "conversations", "export", write), full=True))
    norm = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return back.select("id", "identifier", "fact_text", "source", "importance", "content_hash", "ttl_seconds", "created_at", "promotion_state", F.size("embedding").cast("long").alias("dim"), F.round(norm, 4).alias("norm"))


def q_payload_round_trip(s, d):
    """Rows as the payloads of events, and as rows again."""
    rows = conform(memories(s, d))
    log = rows.select(F.row_number().over(W.partitionBy("source").orderBy("id")).cast("long").alias("seq"), F.col("id").alias("memory_id"), F.lit("memory.created").alias("event_type"), events.payload(rows).alias("payload_json"))
    return events.created_rows(log).select("id", "identifier", "importance", "ttl_seconds", "promotion_candidate", "tier", "content_hash")


def q_loaded_and_skipped(s, d):
    """What each of three inserts loads and skips."""

    def write(at: str) -> DataFrame:
        store, e, told = Store(s, at), event_rows(s, d), []
        for n in range(3):
            batch = e.where(F.col("seq") % 3 == n).select(F.concat("memory_id", F.lit("-"), (F.col("seq") % 5).cast("string")).alias("id"), "seq")
            loaded = store.insert_ignore(batch.orderBy("seq").drop("seq"))
            told.append((n, loaded, batch.count() - loaded))
        return s.createDataFrame(told, "batch int, loaded long, skipped long")

    return _stored(s, d, "events", "inserts", write)


def q_bundle_index(s, d):
    """The latest entry of each path of an index that was written three times."""

    def write(at: str) -> Store:
        store, p = Store(s, at), _table(s, d, "pages")
        for n in range(3):
            store.append(bundles=p.where(F.col("page_id") % 3 >= n).select((F.col("page_id") % 100).cast("string").alias("path"), F.lit(f"run {n}").alias("primary_file"), "page_id").groupBy("path", "primary_file").agg(F.sum("page_id").alias("size_hint")))
        return store

    return _stored(s, d, "pages", "bundles", write).bundles().select("path", "primary_file", "size_hint")


def q_hydrate_many(s, d):
    """Contents in the order of ids, some of which are unknown or asked for twice."""
    nothing = {"source_uri": "string", "byte_offset": "long", "byte_length": "long", "source_checksum": "string"}
    rows = memories(s, d).select("id", "fact_text", F.lit("fact").alias("memory_type"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    ids = _table(s, d, "benchmark").select(F.col("item_id").alias("pos"), F.md5(F.concat((F.col("item_id") % 30).cast("string"), F.lit(":"), F.when(F.col("item_id") % 5 == 0, "none").otherwise("0"))).alias("id"))
    return hydrate.hydrate_many(rows, ids).select("pos", "id", F.sha2("content", 256).alias("h"), "verified", "reason")


def q_files_of_identifier(s, d):
    p = _table(s, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string")).alias("identifier"), F.col("url").alias("source_uri"), F.when(F.col("page_id") % 3 > 0, "file").otherwise("fact").alias("memory_type"))
    return lists.file_backed(p).where(F.col("identifier") == "site3").select("id", "source_uri")


def q_state_counts(s, d):
    """Every state in order, with the rows in it and the states that may follow."""
    held = memories(s, d).groupBy(F.col("promotion_state").alias("state")).agg(F.count("*").alias("n"))
    return lifecycle.states(s).join(held, "state", "left").select("position", "state", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.array_join("next", ",").alias("next"))


def q_known_hashes(s, d):
    """Which hashes of a table the store has."""
    asked = _keys(s, d).select("content_hash").distinct()
    have = version_store(s, d).holding(asked.withColumn("id", F.lit(None).cast("string"))).select("content_hash", F.lit(True).alias("known"))
    return asked.join(have, "content_hash", "left").select("content_hash", F.coalesce("known", F.lit(False)).alias("known"))


def q_null_hashes(s, d):
    """Hashes that are null or empty never collide, in the store or in what is new."""
    e = event_rows(s, d)
    digest = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") != "error", F.md5(F.concat_ws(":", (F.col("seq") % 97).cast("string"), "event_type")))
    rows = e.select("seq", digest.alias("content_hash"))
    store = dedup.first_by_hash(rows.where("seq % 2 = 0"), ["seq"])
    return dedup.merge(store, rows.where("seq % 2 = 1"), ["seq"])


def q_search_max_chars(s, d):
    return search.budgeted(_hybrid(s, d), 2500).select("id", "rank", "content")


def q_context_block(s, d):
    return search.context_block(_hybrid(s, d, 5))


def q_dedup_first(s, d):
    return dedup.first_by_hash(doc_rows(s, d), ["doc_id"]).select("doc_id", "content_hash")


def q_merge_dedup(s, d):
    rows = doc_rows(s, d).select("doc_id", "content_hash")
    store = dedup.first_by_hash(rows.where(F.pmod("doc_id", F.lit(2)) == 0), ["doc_id"])
    return dedup.merge(store, rows.where(F.pmod("doc_id", F.lit(2)) == 1), ["doc_id"])


def q_dedup_anti(s, d):
    rows = doc_rows(s, d).select("doc_id", "content_hash")
    return dedup.not_in_store(rows.where(F.pmod("doc_id", F.lit(2)) == 1), rows.where(F.pmod("doc_id", F.lit(2)) == 0), "content_hash").select("doc_id", "content_hash")


def q_insert_ignore(s, d):
    """Ids and hashes repeat, so that some rows are first of one of them only."""
    e = event_rows(s, d)
    digest = F.when(F.col("event_type") == "error", "").otherwise(F.md5(F.concat_ws(":", (F.col("seq") % 97).cast("string"), "event_type")))
    return dedup.insert_order(e.select("seq", F.concat("memory_id", F.lit("/"), (F.col("seq") % 3).cast("string")).alias("id"), digest.alias("content_hash")))


def q_event_since_offset(s, d):
    """The bound has an offset: 03:00 at +02:00 is 01:00 in UTC."""
    return events.select_events(event_rows(s, d), event_type="signup", since="2024-01-01T03:00:00+02:00").select("seq", "memory_id", "occurred_at")


def q_occurred_at_utc(s, d):
    """Stamps written with another offset for each row."""
    hours = F.pmod("event_id", F.lit(9)).cast("int")
    there = F.date_format(F.expr("ts + make_dt_interval(0, pmod(event_id, 9))"), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(hours == 0, F.concat(there, F.lit("Z"))).otherwise(F.concat(there, F.format_string("+%02d:00", hours)))
    return _table(s, d, "events").select("event_id", events.utc(stamp).alias("occurred_at"))


def q_durable_cues(s, d):
    """The real cue words, put into every third text."""
    c = _table(s, d, "conversations")
    cue = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, F.concat(F.lit("From now on, "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return lists.durable_facts(c.withColumn("text", cue))


def q_upsert_latest(s, d):
    e = event_rows(s, d)
    log = e.select("seq", F.col("memory_id").alias("id"), F.when(F.col("event_type") == "view", F.sha2("payload_json", 256)).otherwise("").alias("content_hash"))
    return dedup.live_versions(log)


def q_event_filter(s, d):
    return events.select_events(event_rows(s, d), namespace="u3", event_type="purchase", since="2024-01-01T00:00:00Z", after_seq=100).select("seq", "memory_id", "occurred_at")


def q_event_page(s, d):
    return events.page(event_rows(s, d), 50, False, before_seq=700).select("seq", "memory_id", "event_type")


def q_event_retention(s, d):
    return events.trim_to(event_rows(s, d), 300).select("seq", "event_type")


def q_event_trim_before(s, d):
    return events.trim_before(event_rows(s, d), 500).select("seq", "event_type")


def q_event_replay(s, d):
    m = memories(s, d).withColumn("seq", F.row_number().over(W.partitionBy("source").orderBy("id")).cast("long"))
    log = m.select("seq", F.col("id").alias("memory_id"), F.lit("memory.created").alias("event_type"), F.to_json(F.struct("id", "identifier", "fact_text", "importance", "content_hash", "created_at")).alias("payload_json"))
    return events.created_rows(log).select("id", "identifier", "importance", "promotion_state", "content_hash")


def q_audit_replay(s, d):
    e = _table(s, d, "events")
    h = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("memory_id"), F.col("props").alias("new_memory"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), F.lit(0).alias("is_deleted"), F.when(F.pmod("user_id", F.lit(3)) == 0, F.lit(None)).otherwise(F.concat(F.lit("a"), F.col("user_id").cast("string"))).alias("actor_id"))
    return events.audit_replay(h)


def q_snapshot_id(s, d):
    return lists.ordered_hash(dedup.first_by_hash(doc_rows(s, d), ["doc_id"]), "content_hash")


def q_hygiene_stats(s, d):
    return hygiene.stats(doc_rows(s, d))


def q_hygiene_warnings(s, d):
    return hygiene.warnings(doc_rows(s, d).withColumn("fact_text", F.repeat("fact_text", 8)))


def q_hygiene_counts(s, d):
    return hygiene.counts(q_hygiene_warnings(s, d))


def q_lifecycle_validate(s, d):
    m = memories(s, d)
    to = F.element_at(F.array(*(F.lit(x) for x in lifecycle.STATES)), (F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("long"), F.lit(4)) + 1).cast("int"))
    return lifecycle.validate(m.select("id", "promotion_state", to.alias("to_state")))


def q_profile_compact(s, d):
    return lists.profile(doc_rows(s, d), "compact").select("id", "identifier", "memory_type", "text_chars")


def q_profile_agent(s, d):
    return lists.profile(doc_rows(s, d), "agent").select("id", "content", "truncated")


def q_agent_truncate(s, d):
    return _table(s, d, "documents").select("doc_id", F.md5(agent_truncate(F.col("text"))).alias("h"))


def q_jsonl_inspect(s, d):
    return inspectors.jsonl_columns(inspectors.jsonl_lines(_table(s, d, "events"), "event_id", "props"), "event_id").select("key", "n")


def q_jsonl_summary(s, d):
    return inspectors.jsonl_summary(inspectors.jsonl_lines(_table(s, d, "events"), "event_id", "props"), "event_id").select("rows", "invalid")


def q_resolve_uri(s, d):
    uri = F.when(F.pmod("page_id", F.lit(2)) == 0, F.col("url")).otherwise(F.concat(F.lit("pages/"), F.col("page_id").cast("string")))
    return _table(s, d, "pages").select("page_id", resolve_uri(uri, "/data").alias("uri"))


def q_file_backed_scan(s, d):
    p = _table(s, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("source_uri"), F.when(F.pmod("page_id", F.lit(3)) > 0, "file").otherwise("fact").alias("memory_type"), F.octet_length("html").cast("long").alias("byte_length"))
    return lists.file_backed(p).select("id", "source_uri", "byte_length")


def q_missing_files(s, d):
    p = _table(s, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("source_uri"), F.lit("file").alias("memory_type"), F.lit(0).cast("long").alias("byte_offset"), F.octet_length("html").cast("long").alias("byte_length"))
    listing = _table(s, d, "pages").where(F.pmod("page_id", F.lit(4)) > 0).groupBy(F.col("url").alias("path")).agg(F.max(F.octet_length("html")).cast("long").alias("length"))
    return lists.files_missing(p, listing, "/data").where("missing").select("id", "uri")


def q_durable_facts(s, d):
    return lists.durable_facts(_table(s, d, "conversations"), cues=r"(?i)(^|[ .,])(the|der|que|la)([ .,]|$)")


def q_turn_rows(s, d):
    return lists.turn_rows(_table(s, d, "conversations"))


def q_hydrate_order(s, d):
    ids = _table(s, d, "benchmark").select(F.col("item_id").alias("pos"), F.md5(F.concat(F.col("item_id").cast("string"), F.lit(":0"))).alias("id"))
    return lists.hydrate_order(memories(s, d).select("id", "fact_text"), ids)


def q_mirrored_writes(s, d):
    target = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "memory").otherwise("other")
    writes = event_rows(s, d).select("seq", target.alias("target"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"))
    return lists.mirrored_writes(writes).select("seq", "target", "importance", "ttl_seconds")


def q_hydrate_inline(s, d):
    nothing = {"source_uri": "string", "byte_offset": "long", "byte_length": "long", "source_checksum": "string"}
    rows = memories(s, d).select("id", "fact_text", F.lit("fact").alias("memory_type"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    return hydrate.hydrate(rows).select("id", F.sha2("content", 256).alias("h"), "verified")


def q_file_hash(s, d):
    key = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    return _table(s, d, "pages").select("page_id", file_hash(key, F.col("url"), F.lit(0), F.octet_length("html"), F.sha2("html", 256)).alias("content_hash"))


def q_vector_round_trip(s, d):
    v = _table(s, d, "embeddings").select("vec_id", decode_vector(encode_vector(F.col("embedding"))).alias("v"))
    ends = (F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"), F.array_min("v").alias("least"), F.array_max("v").alias("most"))
    return v.select("vec_id", F.size("v").cast("long").alias("dim"), *ends).select("vec_id", "dim", *(F.col(c).cast("double") for c in ("first", "last", "least", "most")))


def q_event_windows(s, d):
    return event_stream.counts_by_window(event_rows(s, d)).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def q_lifecycle_apply(s, d):
    e = event_rows(s, d)
    versions = e.groupBy(F.col("memory_id").alias("id")).agg(F.min("seq").alias("seq")).withColumns({"promotion_state": F.lit("HOT"), "promotion_candidate": F.lit(0), "updated_at": F.lit(None).cast("string")})
    state = F.when(F.col("event_type") == "purchase", "READY").when(F.col("event_type") == "signup", "PROMOTED")
    updates = e.select(F.col("memory_id").alias("id"), "seq", state.alias("promotion_state"), F.when(F.col("event_type") == "error", 1).alias("promotion_candidate"), F.col("occurred_at").alias("updated_at"))
    return lifecycle.apply_updates(versions, updates).select("id", "seq", "promotion_state", "promotion_candidate", "updated_at")


def q_all_rows(s, d):
    return lists.all_rows(memories(s, d)).select("id", "identifier", "fact_text", "source", "promotion_candidate")


def q_replay_events(s, d):
    """What the replay iterator reads, without its order."""
    return events.select_events(event_rows(s, d), after_seq=700).select("seq", "memory_id", "event_type", "occurred_at")


def q_key_order(s, d):
    """Keys by the line and the place where each is first seen."""
    return inspectors.jsonl_columns(inspectors.jsonl_lines(_table(s, d, "events"), "event_id", "props"), "event_id")


def q_stored_vectors(s, d):
    """Which stored vectors may be used again: some aren't base64, are short, of another size or another model."""
    n = F.col("vec_id")
    encoded = F.when(n % 7 == 0, "%%%").when(n % 7 == 1, F.base64(F.lit("short").cast("binary"))).when(n % 7 > 2, F.base64(encode_vector(F.col("embedding"))))
    dim, model = F.when(n % 3 == 0, 32).otherwise(DIM), F.when(n % 5 == 0, "other").otherwise(MODEL)
    return _table(s, d, "embeddings").select("vec_id", stored_vector_ok(encoded, dim, model, DIM, MODEL).alias("ok"))


def q_hygiene_findings(s, d):
    """Files and bundles that aren't there any more, and counts beyond their thresholds."""
    pages = _table(s, d, "pages")
    local = F.col("page_id") % 2 == 1
    uri = F.when(local, F.concat(F.lit("/data/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("s3://bucket/"), F.col("page_id").cast("string")))
    files = pages.select(F.col("page_id").cast("string").alias("id"), uri.alias("source_uri"), F.lit("file").alias("memory_type"), F.lit("").alias("fact_text"), F.lit(0).cast("long").alias("byte_offset"), F.octet_length("html").cast("long").alias("byte_length"))
    there = pages.where("page_id % 4 = 1").select(uri.alias("path"), F.octet_length("html").cast("long").alias("length"))
    missing = lists.files_missing(files, there, "/data").where("missing").select("id", (~F.col("uri").contains("://")).alias("checkable"))
    entries = pages.where("page_id % 6 = 0").select(F.concat(F.lit("b/"), F.col("page_id").cast("string")).alias("path"))
    folders = pages.where("page_id % 9 > 0").select(F.concat(F.lit("b/"), F.col("page_id").cast("string")).alias("path"))
    return hygiene.warnings(files, missing, bundle.stale(entries, folders))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

