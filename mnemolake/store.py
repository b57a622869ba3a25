"""A store on Parquet: append-only batches of versions, postings, updates and events, and a pointer that makes them visible.

Each write puts new folders beside the old ones, then replaces the pointer by a rename. A reader sees the pointer's
batches only, so a write that failed leaves nothing visible. One writer at a time.

What a write replaces is found when it is written: versions are sorted by id and carry Bloom filters on id and hash, so
few keys skip nearly all row groups, and many keys are one join. The seqs of replaced versions are the log `dead`; the
current rows are the versions without them, so reading groups nothing and, while `dead` is small, shuffles nothing.

The pointer holds what each batch has: rows, ranges of seq and of time, counts of types, sums of sizes and the largest
one. Sums are added up and what dies is subtracted, so counts, statistics and the mean length of texts read no batch;
pages of events open the batches that they can lie in; trimming drops batches and writes one at most. Batches lie one
after the other in seq, and events have seqs without gaps within a run, so the n-th newest event is arithmetic.

Compaction merges neighbours of one level (a batch of up to FAN^level * LEVEL_ROWS rows) or everything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators import postings as ix
from mnemolake.operators import search
from mnemolake.operators.dedup import insert_order, live_versions, not_in_store
from mnemolake.operators.events import select_events, utc, utc_text
from mnemolake.operators.lifecycle import apply_updates
from mnemolake.schema import BUNDLE, EVENT, MEMORY, conform, ddl
from mnemolake.work import discard, materialise

UPDATE = (("id", "string", None), ("seq", "long", None), ("promotion_state", "string", None), ("promotion_candidate", "int", None), ("updated_at", "string", None))
#: A version knows how many tokens its text has, so that what dies can be subtracted.
VERSION = (("seq", "long", None), *MEMORY, ("tokens", "int", 0))
#: What is subtracted when a version dies.
DEAD = (("seq", "long", None), ("file", "boolean", None), ("chars", "long", 0), ("bytes", "long", 0), ("tokens", "long", 0))
LOGS = {"versions": VERSION, "updates": UPDATE, "events": EVENT, "bundles": (("seq", "long", None), *BUNDLE), "dead": DEAD}
SUMS = ("total", "inline", "files", "chars", "bytes", "tokens")
#: Keys that are looked up by filters; more are joined. Types of events that a batch's counts may have.
LITERALS, MOST_TYPES = 64, 64
#: Rows of a file, and their bytes as a task that sorts them holds them; replaced versions up to which they are sent to all tasks (about 150 bytes each).
FILE_ROWS, FILE_BYTES, BROADCAST_DEAD = 500_000, 64 << 20, 1 << 17
FAN, LEVEL_ROWS = 8, 1000


def _any(column: str, values: list) -> Column:
    """Equality with any of the values, as equalities: these are looked up in Bloom filters, whatever their number."""
    tests = [F.col(column) == v for v in values]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _sizes() -> list[Column]:
    """(file, chars, bytes) of a memory row, as statistics count them."""
    file = F.col("memory_type") == "file"
    chars = F.when(~file, F.char_length(F.coalesce("fact_text", F.lit(""))).cast("long")).otherwise(0)
    return [file.alias("file"), chars.alias("chars"), F.when(file, F.coalesce("byte_length", F.lit(0))).otherwise(0).cast("long").alias("bytes")]


def _width() -> Column:
    """Bytes of a version in memory: 8 for each column, its vector, and its texts."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind, _ in VERSION if kind in ("string", "binary")]
    return reduce(lambda a, b: a + b, texts, 8 * len(VERSION) + 4 * F.greatest(F.size("embedding"), F.lit(0))).cast("long")


def _sums() -> list[Column]:
    one = {"total": F.count("*"), "inline": F.count_if(~F.col("file")), "files": F.count_if("file")}
    return [c.alias(n) for n, c in one.items()] + [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in SUMS[3:]]


class Store:
    def __init__(self, spark: SparkSession, root: str, stemmed: bool = True, row_group_bytes: int = 16 << 20):
        """stemmed: whether texts are searched by stems or by plain words; it is fixed when a store is begun."""
        self.spark, self.root, self.stemmed, self._group = spark, root.rstrip("/"), stemmed, row_group_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark._jsc.hadoopConfiguration()) if "://" in self.root else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())

    # the pointer

    def _pointer(self) -> dict:
        at = self._path(f"{self.root}/pointer.json")
        if not self._fs.exists(at):
            return {"next": 1, "stemmed": self.stemmed, "live": dict.fromkeys(SUMS, 0), **{k: [] for k in LOGS}}
        stream = self._fs.open(at)
        try:
            state = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if "live" not in state:
            raise ValueError(f"{self.root} was written by an older version: export it with that version and import the export")
        return state

    def _publish(self, state: dict) -> None:
        at, new = self._path(f"{self.root}/pointer.json"), self._path(f"{self.root}/pointer-{uuid.uuid4().hex}")
        stream = self._fs.create(new)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._overwrite
        self._context.rename(new, at, options)

    def vacuum(self) -> int:
        """Removes the folders that the pointer doesn't name; returns how many. Not while another reads an older state."""
        state, gone = self._pointer(), 0
        named = {b[k] for log in LOGS for b in state[log] for k in ("path", "postings") if b.get(k)}
        for log in (*LOGS, "postings", "given"):
            at = self._path(f"{self.root}/{log}")
            for found in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f"{log}/{found.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(found.getPath(), True))
        return gone

    # reading

    def top_seq(self) -> int:
        """No row written yet has a greater seq, every later one has."""
        return self._pointer()["next"] - 1

    def _read(self, columns: tuple, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ddl(columns))
        return self.spark.read.schema(ddl(columns)).parquet(*(f"{self.root}/{p}" for p in paths))

    def log(self, name: str) -> DataFrame:
        return self._read(LOGS[name], [b["path"] for b in self._pointer()[name]])

    def _without_dead(self, state: dict, rows: DataFrame) -> DataFrame:
        dead = self._read(DEAD, [b["path"] for b in state["dead"]]).select("seq")
        n = sum(b["rows"] for b in state["dead"])
        if not n:
            return rows
        # their files are small where their rows are many, so the size of files must not decide
        return rows.join(F.broadcast(dead) if n <= BROADCAST_DEAD else dead.hint("merge"), "seq", "left_anti").select(rows.columns)

    def _versions(self, state: dict) -> DataFrame:
        return self._without_dead(state, self._read(VERSION, [b["path"] for b in state["versions"]]))

    def _live(self, state: dict) -> DataFrame:
        rows = self._versions(state)
        return apply_updates(rows, self._read(UPDATE, [b["path"] for b in state["updates"]])) if state["updates"] else rows

    def current(self) -> DataFrame:
        """Live memory rows with the latest state of each, and seq."""
        return self._live(self._pointer()).select("seq", *(c[0] for c in MEMORY))

    def memories(self) -> DataFrame:
        return self.current().drop("seq")

    def count(self) -> int:
        return self._pointer()["live"]["total"]

    def stats(self) -> DataFrame:
        """What hygiene.stats() gives for memories(), from the pointer alone."""
        state = self._pointer()
        live, largest = state["live"], max((b["largest"] for b in state["versions"]), default=0)
        row = (live["total"], live["inline"], live["files"], live["chars"], live["bytes"], largest)
        return self.spark.createDataFrame([row], "total long, inline_count long, file_count long, inline_chars long, file_bytes long, largest_inline long")

    def postings(self) -> DataFrame:
        """Postings of live rows."""
        state = self._pointer()
        return self._without_dead(state, self._read(ix.POSTING, [b["postings"] for b in state["versions"] if b["postings"]]))

    def bm25(self, query: str) -> DataFrame | None:
        """(seq, bm25), lower is better, of the rows that hold all of the query's phrases; None if it has none.

        Reads the postings of the query's terms. How many rows there are and their mean length come from the pointer.
        """
        state = self._pointer()
        wanted = search.phrases(query, state["stemmed"])
        if not wanted:
            return None
        found = self._without_dead(state, ix.of_query(self._read(ix.POSTING, [b["postings"] for b in state["versions"] if b["postings"]]), wanted))
        live = state["live"]
        return search.bm25_of_counts(ix.counts(found, wanted), len(wanted), live["total"], live["tokens"] / max(1, live["total"]))

    def holding(self, keys: DataFrame) -> DataFrame:
        """Live versions that have the id or the hash of any of keys (id, content_hash); a null or an empty hash asks for nothing."""
        return self._holding(self._pointer(), keys)

    def bundles(self) -> DataFrame:
        """The bundle index: the latest entry of each path, in order of path."""
        entries = self.log("bundles")
        last = entries.groupBy("path").agg(F.max_by(F.struct(*(c for c in entries.columns if c not in ("seq", "path"))), "seq").alias("x"))
        return last.select("path", "x.*").orderBy("path")

    def clear_bundles(self) -> None:
        self._publish(self._pointer() | {"bundles": []})

    # events

    def event_count(self) -> int:
        return sum(b["rows"] for b in self._pointer()["events"])

    def events(self, limit: int | None = None, ascending: bool = True, **conditions) -> DataFrame:
        """The events of the batches that conditions (those of select_events) can be true in.

        With a limit on the first or last of them, and conditions on seq and type only, no more batches than that limit needs.
        """
        given = {k: v for k, v in conditions.items() if v is not None}
        low, high = given.get("after_seq", -1), given.get("before_seq", 1 << 62)
        kind, since, until = given.get("event_type"), given.get("since"), given.get("until")
        there = [b for b in self._pointer()["events"] if b["high"] > low and b["low"] < high]
        if kind is not None:
            there = [b for b in there if b["types"] is None or kind in b["types"]]
        if since is not None:
            there = [b for b in there if b["until"] is not None and b["until"] >= utc_text(since)]
        if until is not None:
            there = [b for b in there if b["since"] is not None and b["since"] <= utc_text(until)]
        if limit is not None and set(given) <= {"after_seq", "before_seq", "event_type"}:
            there, have, found = there if ascending else there[::-1], 0, []
            for b in there:
                if have >= limit:
                    break
                found.append(b)
                if b["low"] > low and b["high"] < high:
                    have += b["rows"] if kind is None else (b["types"] or {}).get(kind, 0)
            there = found
        return select_events(self._read(EVENT, [b["path"] for b in there]), **given)

    def slices(self, after_seq: int = 0, most_rows: int = 10_000) -> Iterator[tuple[int, DataFrame]]:
        """(cursor, events) in order of seq from a cursor on, each event in one slice of at most most_rows; give the last cursor to go on.

        A slice opens the batches that it lies in. What was written meanwhile is found by the next call.
        """
        if most_rows < 1:
            raise ValueError("a slice has at least one row")
        batches, at = self._pointer()["events"], after_seq
        runs = sorted((low, n) for b in batches for low, n in b["runs"] if low + n - 1 > after_seq)
        while runs:
            left, end = most_rows, at
            while runs and left:
                low, n = runs[0]
                first = max(low, end + 1)
                took = min(left, low + n - first)
                end, left = first + took - 1, left - took
                if end == low + n - 1:
                    runs.pop(0)
            there = [b["path"] for b in batches if b["high"] > at and b["low"] <= end]
            yield end, self._read(EVENT, there).where((F.col("seq") > at) & (F.col("seq") <= end))
            at = end

    def trim_events(self, keep: int) -> None:
        """The last `keep` events stay, with their seq."""
        if keep < 0:
            raise ValueError("keep must not be negative")
        left, bound = keep, 1 << 62
        for low, n in sorted(((low, n) for b in self._pointer()["events"] for low, n in b["runs"]), reverse=True):
            if not left:
                break
            took = min(left, n)
            left, bound = left - took, low + n - took
        self.trim_events_before(bound)

    def trim_events_before(self, seq: int) -> None:
        """Events before seq go: whole batches without being read, the one that seq lies in is written anew."""
        state = self._pointer()
        kept = [b for b in state["events"] if b["high"] >= seq]
        if kept and kept[0]["low"] < seq:
            rest = [(max(low, seq), low + n - max(low, seq)) for low, n in kept[0]["runs"] if low + n > seq]
            kept[0] = self._event_batch(self._read(EVENT, [kept[0]["path"]]).where(F.col("seq") >= seq), rest)
        self._publish(state | {"events": kept})

    def compact_events(self) -> None:
        """Merges neighbouring small batches of events; what the pointer knows of them is merged too, not read."""
        state, out, held = self._pointer(), [], []

        def merged() -> None:
            if len(held) > 1:
                path = f"events/{uuid.uuid4().hex}"
                rows = self._read(EVENT, [b["path"] for b in held])
                files = -(-sum(b["rows"] for b in held) // FILE_ROWS)
                (rows.repartitionByRange(files, "seq") if files > 1 else rows.coalesce(1)).sortWithinPartitions("seq").write.parquet(f"{self.root}/{path}")
                types = None if any(b["types"] is None for b in held) else {}
                for b in held if types is not None else []:
                    for k, n in b["types"].items():
                        types[k] = types.get(k, 0) + n
                types = types if types is not None and len(types) <= MOST_TYPES else None
                ends = [[b[k] for b in held if b[k] is not None] for k in ("since", "until")]
                out.append({"path": path, "rows": sum(b["rows"] for b in held), "low": held[0]["low"], "high": held[-1]["high"], "runs": [r for b in held for r in b["runs"]], "types": types, "since": min(ends[0], default=None), "until": max(ends[1], default=None)})
            else:
                out.extend(held)
            held.clear()

        for b in state["events"]:
            if b["rows"] >= FILE_ROWS or sum(x["rows"] for x in held) + b["rows"] > 2 * FILE_ROWS:
                merged()
            held.append(b)
        merged()
        self._publish(state | {"events": out})

    def _event_batch(self, rows: DataFrame, runs: list | None = None, first: int = 0) -> dict | None:
        """Writes events as a batch. runs: (first seq, rows) where they are known; else they follow from the tasks that numbered the rows from `first` on."""
        path = f"events/{uuid.uuid4().hex}"
        conform(rows, EVENT).write.parquet(f"{self.root}/{path}")
        part = F.shiftright(F.col("seq") - first, 33).alias("part")
        told = [F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.min("occurred_at").alias("since"), F.max("occurred_at").alias("until")]
        parts = self._read(EVENT, [path]).groupBy(part, "event_type").agg(*told)
        kinds = parts.groupBy("event_type").agg(F.sum("n").alias("n")).limit(MOST_TYPES + 1).collect()
        found = parts.groupBy("part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("since").alias("since"), F.max("until").alias("until")).orderBy("part").collect()
        if not found:
            return None
        if runs is None:
            runs = [(r.low, r.n) for r in found]
        types = {r.event_type: r.n for r in kinds if r.event_type is not None} if len(kinds) <= MOST_TYPES else None
        ends = [[r[k] for r in found if r[k] is not None] for k in ("since", "until")]
        return {"path": path, "rows": sum(r.n for r in found), "low": min(r.low for r in found), "high": max(r.high for r in found), "runs": runs, "types": types, "since": min(ends[0], default=None), "until": max(ends[1], default=None)}

    # writing

    def append(self, **frames: DataFrame) -> None:
        """Appends frames to their logs in one step. seq rises across calls; in a call it follows the frame's partitions.

        versions replace by id and by hash, the later in order of seq.
        """
        state = self._pointer()
        for name, df in frames.items():
            if name == "versions":
                given, path = self._given(df, state)
                self._replace(state, given)
                self._fs.delete(self._path(f"{self.root}/{path}"), True)
                continue
            numbered = df.withColumn("seq", F.monotonically_increasing_id() + F.lit(state["next"]))
            if name == "events":
                batch = self._event_batch(numbered.withColumn("occurred_at", utc(F.col("occurred_at"))), first=state["next"])
            else:
                path = f"{name}/{uuid.uuid4().hex}"
                conform(numbered, LOGS[name]).write.parquet(f"{self.root}/{path}")
                row = self._read(LOGS[name], [path]).agg(F.count("*").alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
                batch = {"path": path, **row.asDict()} if row.rows else None
            if batch:
                state[name].append(batch)
                state["next"] = batch["high"] + 1
        self._publish(state)

    def upsert(self, rows: DataFrame, events: DataFrame | None = None) -> None:
        """Replaces by id and by hash."""
        self.append(**{"versions": rows} | ({} if events is None else {"events": events}))

    def insert_ignore(self, rows: DataFrame) -> int:
        """Adds rows whose id and hash are new, in order, first wins by both; returns how many live because of it."""
        state = self._pointer()
        given, path = self._given(rows, state)
        keys = given.select("seq", "id", "content_hash")
        taken = materialise(insert_order(not_in_store(keys, self._holding(state, keys), "id", "content_hash")).select(F.col("seq").alias("_s")), "taken")
        batch = self._version_batch(given.join(taken, F.col("seq") == F.col("_s"), "left_semi"))
        self._fs.delete(self._path(f"{self.root}/{path}"), True)
        discard(taken)
        if not batch:
            return 0
        self._publish(self._with_batch(state, batch))
        return batch["rows"]

    def _given(self, rows: DataFrame, state: dict) -> tuple[DataFrame, str]:
        """Rows with seq and terms, written first: seq has to be the same each time that they are read, and texts are split once."""
        path = f"given/{uuid.uuid4().hex}"
        numbered = conform(rows.withColumn("seq", F.monotonically_increasing_id() + F.lit(state["next"])), VERSION[:-1])
        split = numbered.withColumn("terms", ix.terms_of(F.col("fact_text"), state["stemmed"])).withColumn("tokens", F.col("terms.length"))
        split.write.parquet(f"{self.root}/{path}")
        return self.spark.read.schema(split.schema).parquet(f"{self.root}/{path}"), path

    def _version_batch(self, given: DataFrame, merged: DataFrame | None = None, at_most: int | None = None) -> dict | None:
        """Writes versions sorted by id, and their postings sorted by term: those of `terms`, or `merged` ones. at_most: rows, where they are few."""
        path, index = f"versions/{uuid.uuid4().hex}", f"postings/{uuid.uuid4().hex}"
        rows = conform(given, VERSION)
        n, size = (at_most, 0) if at_most is not None else rows.agg(F.count("*"), F.sum(_width())).first()
        if not n:
            return None
        files = max(-(-n // FILE_ROWS), -(-size // FILE_BYTES))
        sorted_rows = (rows.repartitionByRange(files, "id", "seq") if files > 1 else rows.coalesce(1)).sortWithinPartitions("id", "seq")
        writer = sorted_rows.write.option("parquet.block.size", self._group)
        for c in ("id", "content_hash"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", -(-n // files))
        writer.parquet(f"{self.root}/{path}")
        written = self._read(VERSION, [path])
        row = written.select("seq", "tokens", *_sizes()).agg(*_sums(), F.min("seq").alias("low"), F.max("seq").alias("high"), F.coalesce(F.max("chars"), F.lit(0)).alias("largest")).first()
        if not row.total:
            return None
        found = ix.postings(given) if merged is None else merged
        if row.tokens:
            # tokens are more than postings
            ix.ordered(found, row.tokens).write.option("parquet.block.size", self._group).parquet(f"{self.root}/{index}")
        return {"path": path, "postings": index if row.tokens else None, "rows": row.total, "low": row.low, "high": row.high, "largest": row.largest, "sums": {k: row[k] for k in SUMS}}

    @staticmethod
    def _with_batch(state: dict, batch: dict) -> dict:
        for k, n in batch.pop("sums").items():
            state["live"][k] += n
        state["versions"].append(batch)
        state["next"] = max(state["next"], batch["high"] + 1)
        return state

    @staticmethod
    def _few(keys: DataFrame) -> list | None:
        """The keys, if they are few enough to be looked up by filters."""
        few = keys.limit(LITERALS + 1).collect()
        return few if len(few) <= LITERALS else None

    def _holding(self, state: dict, keys: DataFrame, few: list | None = None) -> DataFrame:
        """Live versions that have the id or the hash of any of keys (id, content_hash); few keys are filters, which skip row groups."""
        live, few = self._versions(state), few or self._few(keys)
        if few is None:
            ids = keys.select(F.col("id").alias("_id")).where("_id IS NOT NULL").distinct()
            hashes = keys.select(F.col("content_hash").alias("_hash")).where("_hash != ''").distinct()
            met = live.join(ids, F.col("id") == F.col("_id"), "left").join(hashes, F.col("content_hash") == F.col("_hash"), "left")
            return met.where(F.col("_id").isNotNull() | F.col("_hash").isNotNull()).drop("_id", "_hash")
        asked = {"id": sorted({r.id for r in few if r.id is not None}), "content_hash": sorted({r.content_hash for r in few if r.content_hash})}
        tests = [_any(c, values) for c, values in asked.items() if values]
        return live.where(reduce(lambda a, b: a | b, tests)) if tests else live.limit(0)

    def _replace(self, state: dict, given: DataFrame) -> None:
        """Adds a batch to state and what dies of it to `dead`: older versions of its ids and hashes, and those that it replaces itself."""
        keys = given.select("seq", "id", "content_hash")
        few, path = self._few(keys), f"dead/{uuid.uuid4().hex}"
        shape = ["seq", *_sizes(), F.col("tokens").cast("long").alias("tokens")]
        older = self._holding(state, keys, few).select(*shape) if state["versions"] else None
        if few is None:
            last = live_versions(keys).select(F.col("seq").alias("_s"))
            own = given.join(last, F.col("seq") == F.col("_s"), "left_anti").select(*shape)
            (own if older is None else own.unionByName(older)).write.parquet(f"{self.root}/{path}")
        else:
            # a key has one live version at most, so what few keys replace is few too
            last_of = {k: r.seq for r in sorted(few, key=lambda r: r.seq) for k in (("id", r.id), ("hash", r.content_hash))}
            lost = [r.seq for r in few if r.id is not None and last_of["id", r.id] > r.seq or r.content_hash and last_of["hash", r.content_hash] > r.seq]
            rows = [tuple(r) for df in ([given.where(F.col("seq").isin(lost)).select(*shape)] if lost else []) + ([] if older is None else [older]) for r in df.collect()]
            if rows:
                self.spark.createDataFrame(rows, ddl(DEAD)).coalesce(1).write.parquet(f"{self.root}/{path}")
        batch = self._version_batch(given, at_most=None if few is None else len(few))
        if batch:
            self._with_batch(state, batch)
        if few is not None and not rows:
            return
        dead = self._read(DEAD, [path])
        gone = dead.agg(*_sums()).first()
        if not gone.total:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
            return
        state["dead"].append({"path": path, "rows": gone.total})
        for k in SUMS:
            state["live"][k] -= gone[k]
        # a batch whose largest row may have died is looked at again
        place = F.size(F.filter(F.lit([b["high"] for b in state["versions"]]), lambda high: high < F.col("seq")))
        hit = {r.place: r.chars for r in dead.groupBy(place.alias("place")).agg(F.max("chars").alias("chars")).collect()}
        for i, chars in hit.items():
            b = state["versions"][i]
            if chars >= b["largest"] > 0:
                left = self._without_dead(state, self._read(VERSION, [b["path"]]))
                b["largest"] = left.select(*_sizes()).agg(F.coalesce(F.max("chars"), F.lit(0))).first()[0]

    # compaction

    def compact(self) -> None:
        """Writes the live rows, with their state, as one batch; seq stays, so later updates still find their version."""
        state = self._pointer()
        if not state["versions"]:
            return
        batch = self._version_batch(self._live(state), self._index(state, state["versions"]))
        if batch:
            batch.pop("sums")
        self._publish(state | {"versions": [batch] if batch else [], "updates": [], "dead": []})

    def _index(self, state: dict, batches: list[dict]) -> DataFrame:
        return self._without_dead(state, self._read(ix.POSTING, [b["postings"] for b in batches if b["postings"]]))

    def compact_level(self) -> bool:
        """Merges FAN neighbours of one level, the smallest level first, and leaves all others alone; whether there were such."""
        state = self._pointer()

        def level(b: dict) -> int:
            n, rows = 0, b["rows"]
            while rows > LEVEL_ROWS * FAN**n:
                n += 1
            return n

        levels = [level(b) for b in state["versions"]]
        for wanted in sorted(set(levels)):
            for first in range(len(levels) - FAN + 1):
                if all(x == wanted for x in levels[first : first + FAN]):
                    return self._merge(state, first, first + FAN)
        return False

    def _merge(self, state: dict, first: int, last: int) -> bool:
        old = state["versions"][first:last]
        rows = self._without_dead(state, self._read(VERSION, [b["path"] for b in old]))
        batch = self._version_batch(rows, self._index(state, old))
        if batch:
            batch |= {"low": old[0]["low"], "high": old[-1]["high"]}
            batch.pop("sums")
        state["versions"][first:last] = [batch] if batch else []
        inside = F.col("seq").between(old[0]["low"], old[-1]["high"])
        if state["dead"]:
            path = f"dead/{uuid.uuid4().hex}"
            self._read(DEAD, [b["path"] for b in state["dead"]]).where(~inside).coalesce(1).write.parquet(f"{self.root}/{path}")
            n = self._read(DEAD, [path]).count()
            state["dead"] = [{"path": path, "rows": n}] if n else []
        self._publish(state)
        return True
