"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

Every window of an item (13 words, or the whole of a shorter item) is a set of word shingles that a document must
contain in full. Shingles are ordered by rarity, counted over all documents; at containment 1 the necessary prefix of
a window is its rarest shingle. Documents join only on those: a hit at a position gives the one place where the window
can lie (positional bound), which must be inside the document (length bound), and there all words are compared.

How the work is dealt out:
1. windows and their shingles are a table; what tasks get of it is a bitmap of bounded size, never its rows;
2. one pass of the documents, whatever the size of the benchmark: where a shingle is in the bitmap, it gives the place, and
   the words around it in chunks of a grid. A full bitmap lets more through, and nothing else changes;
3. the rest are joins of what was found: shingles with their number, windows with their rarest shingle, hits with
   windows on it, and with the chunk of words that their place is in. Equal texts are one row there.

Defined results: a null or empty text has no words and no hits; an empty benchmark contaminates nothing; items without
words have no windows; a null item_id is the empty string; rows of equal item_id count as one item; repeated rows of
documents each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm import words
from mnemolake.llm.common import arrow_map, broadcast_if_small, discard, free_name, materialise, whole_text

WINDOW, SHINGLE = 13, 5
#: A bitmap has about so many bits for each shingle, and never more than 2 ** MOST_BITS (16 MB); so many of them are tested.
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES = 32, 16, 27, 4
_BLOCK_BITS = 15
#: Words are handed on in chunks that start at multiples of GRID and hold a whole window from any of their first GRID words.
GRID = 64

_WINDOWS = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))]))


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> list[str]:
    """The words [first, last) of a text, in lower case."""
    begin, end = int(starts[first]), int(ends[last - 1])
    return [w.decode("utf-8", "surrogatepass") for w in words.word_list(raw[begin:end], starts[first:last] - begin, ends[first:last] - begin)]


@arrow_map(_WINDOWS)
def _text_windows(text: str) -> list[dict]:
    raw = words.raw_bytes(text)
    starts, ends = words.spans(raw)
    h, w = words.hashes(raw, starts, ends), _words(raw, starts, ends, 0, len(starts)) if len(starts) else []
    n, k = min(WINDOW, len(w)), min(SHINGLE, len(w))
    s = words.shingles(h, k).view(np.int64).tolist() if len(w) else []
    return [{"words": w[i : i + n], "k": k, "shingles": s[i : i + n - k + 1]} for i in range(len(w) - n + 1)] if n else []


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(window, item, words, k, shingles): a row for each different window of each item; window is a digest of the words."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole_text().alias("text")).distinct()
    rows = rows.select("item", F.explode(_text_windows(F.col("text"))).alias("w")).select("item", "w.*")
    return rows.withColumn("window", F.substring(F.unhex(F.sha2(F.array_join("words", " "), 256)), 1, 16)).dropDuplicates(["item", "window"])


def _probes(s: np.ndarray, k: int, probe: int, bits: int) -> np.ndarray:
    step = np.uint64((k * PROBES + probe) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (words.mix(s + step) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(shingles: DataFrame) -> tuple[list[int], int, np.ndarray]:
    """The lengths of shingles (k, s), how many bits address the bitmap, and the bitmap; what comes to the driver is bounded."""
    told = shingles.groupBy("k").agg(F.count("*").alias("n")).collect()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * sum(r.n for r in told)).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, k = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(0).to_numpy(zero_copy_only=False)
            at = [_probes(s[k == one], int(one), p, bits) for one in np.unique(k) for p in range(PROBES)]
            at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _BLOCK_BITS), pa.array((at & ((1 << _BLOCK_BITS) - 1)).astype(np.int32))], names=["block", "at"])

    def blocks(table: pa.Table) -> pa.Table:
        held = np.zeros(1 << _BLOCK_BITS, bool)
        held[table.column("at").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1].cast(pa.int64()), "held": pa.array([np.packbits(held).tobytes()])})

    rows = shingles.select("k", "s").mapInArrow(places, "block long, at int").distinct().groupBy("block").applyInArrow(blocks, "block long, held binary")
    out = np.zeros((1 << (bits - _BLOCK_BITS), 1 << (_BLOCK_BITS - 3)), np.uint8)
    for r in rows.toLocalIterator():
        out[r.block] = np.frombuffer(r.held, np.uint8)
    return sorted(r.k for r in told), bits, out.ravel()


_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("at", pa.int32())]))), ("chunks", pa.list_(pa.struct([("chunk", pa.int32()), ("words", pa.list_(pa.string()))])))])


def _scan(documents: DataFrame, lengths: list[int], bits: int, bitmap: np.ndarray) -> Column:
    """struct(n_words, hits, chunks) of the text: shingles in the bitmap with their places, and the words around them."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    @arrow_map(_FOUND)
    def scan(text: str) -> dict:
        raw, held = words.raw_bytes(text), shared.value
        starts, ends = words.spans(raw)
        n, hits, chunks = len(starts), [], set()
        h = words.hashes(raw, starts, ends) if lengths else starts
        for k in lengths:
            if n < k:
                continue
            s = words.shingles(h, k)
            at = np.arange(len(s))
            for probe in range(PROBES):
                p = _probes(s[at], k, probe, bits)
                at = at[(held[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
            hits += [{"k": k, "s": x, "at": p} for x, p in zip(s[at].view(np.int64).tolist(), at.tolist(), strict=True)]
            # a window with the shingle starts at most WINDOW - k words before it
            chunks.update(np.unique(at // GRID).tolist(), np.unique(np.maximum(at - (WINDOW - k), 0) // GRID).tolist())
        return {"n_words": n, "hits": hits, "chunks": [{"chunk": c, "words": _words(raw, starts, ends, c * GRID, min(n, (c + 1) * GRID + WINDOW - 1))} for c in sorted(chunks)]}

    return scan(whole_text())


def _key() -> Column:
    return F.substring(F.unhex(F.sha2(whole_text(), 256)), 1, 16)


def _occurrences(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, first, n, window) as a table: where windows occur in the texts of scanned (key, hits, chunks)."""
    some = scanned.where(F.size("hits") > 0).groupBy("key").agg(F.count("*").alias("copies"), F.first("hits").alias("hits"), F.first("chunks").alias("chunks"))
    some = materialise(some, "texts")
    hits = some.select("key", "copies", F.explode("hits").alias("h")).select("key", "copies", "h.*")
    counts = hits.groupBy("k", "s").agg(F.sum("copies").alias("n")).withColumnsRenamed({"k": "ck", "s": "cs"})
    each = windows.groupBy("window").agg(F.first("words").alias("words"), F.first("k").alias("k"), F.first("shingles").alias("shingles"))
    shingles = each.select("window", "k", F.posexplode("shingles").alias("offset", "s"))
    ranked = shingles.join(counts, (F.col("k") == F.col("ck")) & (F.col("s") == F.col("cs")), "left")
    rarest = ranked.groupBy("window", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "s", "offset")).alias("r"))
    # a window whose rarest shingle occurs nowhere occurs nowhere
    rarest = materialise(rarest.where("r.n > 0").select("window", F.col("k").alias("rk"), F.col("r.s").alias("rs"), F.col("r.offset").alias("offset")), "rarest")
    places = hits.join(broadcast_if_small(rarest), (F.col("k") == F.col("rk")) & (F.col("s") == F.col("rs")))
    places = places.select("key", "window", (F.col("at") - F.col("offset")).alias("first")).where("first >= 0").withColumn("chunk", F.floor(F.col("first") / GRID).cast("int"))
    chunks = some.select(F.col("key").alias("t"), F.explode("chunks").alias("c")).select("t", F.col("c.chunk").alias("c"), F.col("c.words").alias("held"))
    wanted = each.join(rarest.select(F.col("window").alias("w")), F.col("window") == F.col("w"), "left_semi").select(F.col("window").alias("w"), "words")
    near = places.join(chunks, (F.col("key") == F.col("t")) & (F.col("chunk") == F.col("c"))).join(wanted, F.col("window") == F.col("w"))
    inside = F.slice("held", F.col("first") - F.col("chunk") * GRID + 1, F.size("words"))
    found = materialise(near.where(inside == F.col("words")).select("key", "first", F.size("words").alias("n"), "window"), "occurrences")
    discard(some, rarest)
    return found


def _judged(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words) of each row, and (key, n_hit, n_items, items_sha256) of each text with an occurrence; both are tables."""
    windows = materialise(benchmark_windows(benchmark), "windows")
    shingles = windows.select("k", F.explode("shingles").alias("s")).distinct()
    rows = documents.select("doc_id", _key().alias("key"), _scan(documents, *_bitmap(shingles)).alias("f")).select("doc_id", "key", "f.*")
    scanned = materialise(rows, "scanned")
    found = _occurrences(scanned, windows)
    # the union of intervals: those in order add what lies beyond the last end
    spans = F.array_sort(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["b"]).alias("reach"))
    hit = found.groupBy("key").agg(spans.alias("spans")).select("key", F.aggregate("spans", none, step, lambda acc: acc["n"].cast("long")).alias("n_hit"))
    items = found.select("key", "window").distinct().join(windows.select(F.col("window").alias("w"), "item"), F.col("window") == F.col("w")).select("key", "item").distinct()
    items = items.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    verdicts = materialise(hit.join(items, F.col("key") == F.col("k")).select("key", "n_hit", "n_items", "items_sha256"), "verdicts")
    discard(windows, found)
    return scanned.select("doc_id", "key", "n_words"), verdicts


_CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, verdicts = _judged(documents, benchmark)
    joined = rows.join(broadcast_if_small(verdicts.withColumnRenamed("key", "t")), F.col("key") == F.col("t"), "left")
    told = joined.select("doc_id", "n_words", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return told.withColumn("contaminated", F.expr(_CONTAMINATED))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without its contaminated rows, columns unchanged."""
    rows, verdicts = _judged(documents, benchmark)
    key = free_name(documents, "contaminated_key")
    bad = rows.join(broadcast_if_small(verdicts.select(F.col("key").alias("t"), "n_hit")), F.col("key") == F.col("t")).where(_CONTAMINATED)
    bad = materialise(bad.select(F.col("key").alias(key)).distinct(), "contaminated")
    return documents.join(broadcast_if_small(bad), _key() == F.col(key), "left_anti")
