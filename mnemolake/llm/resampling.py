"""Resampling of documents towards a target distribution, by importance weights over hashed n-grams of words.

One pass turns texts into inverted postings: for each bucket of crc32 blocks of (document, count), a block for each run of
documents in a task. Blocks are shuffled by bucket and salt. Where a bucket's blocks lie, its gain is made from the sums
of both corpora, which were added up before they were shuffled; each posting becomes a contribution (document, count
times gain), and contributions are added up by document, partly before they are shuffled. A bucket that is in all
documents is spread over SALTS tasks; nothing is sent to all tasks but a row of totals, and no bucket is gathered.

The draw adds Gumbel noise from a hash of the id to each weight and takes the highest scores. Documents are sorted over
ranges, and a rank is the place in a range and the number of rows before it, so no task ranks all.

Defined results: a null text has no words; a document without features has weight 0; a null id hashes as the empty text
and is last in ties; rows of equal id and text get equal scores and ranks of their own; an empty target is a target
without features; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemolake.llm import words
from mnemolake.llm.common import broadcast_if_small, discard, materialise, whole_text

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Tasks that the postings of one bucket are spread over.
SALTS = 16
#: Bytes of text that are counted at once, and postings that a task holds before it writes them as blocks.
_SLICE, _HELD = 1 << 20, 1 << 19
#: Bytes of a word that are taken for all words at once; what is longer goes on alone.
_SHORT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _extend(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers of crc32 after the further bytes [start, end) of raw: byte by byte, for all words that are as long."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    register, at, size = state[order], starts[order], size[order]
    for j in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -j, side="left"))
        low = register[:n]
        register[:n] = _CRC[(low ^ raw[at[:n] + j]) & np.uint32(255)] ^ (low >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -_SHORT, side="left"))):
        more = raw[at[i] + _SHORT : at[i] + size[i]].tobytes()
        register[i] = zlib.crc32(more, int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = register
    return out


def features(texts: list[bytes], buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, words before it in texts, bucket) of each feature: the runs of 1 to most_words words of a text, joined by a space."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = words.spans(raw)
    borders = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(borders, starts, side="right")
    low, n = words.LOWER[raw], len(starts)
    state, found, held = np.full(n, 0xFFFFFFFF, np.uint32), [], []
    for k in range(min(most_words, n)):
        left = n - k
        if k:
            state = state[:left]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _extend(state, low, starts[k:], ends[k:])
        whole = of[:left] == of[k:]
        found.append(of[:left][whole])
        held.append((state ^ np.uint32(0xFFFFFFFF))[whole] % np.uint32(buckets))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found) if found else empty), of, (np.concatenate(held).astype(np.int64) if held else empty)


def _blocks(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """A row for each bucket of what is held, with its documents and counts."""
    rows, bucket, count = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(bucket, kind="stable")
    rows, bucket, count = rows[order], bucket[order], count[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    nothing = [pa.nulls(len(first), t) for t in types[:4]]
    total = np.add.reduceat(count, first)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(bucket[first].astype(np.int32)), *lists, pa.array(total)], names=names)


def inverted(rows: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> DataFrame:
    """Of rows (row, doc_id, text), in one pass: a row (row, doc_id, n_words, n_features) for each text and a row (bucket, rows, counts, total) for each block."""
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    names = ["row", "doc_id", "n_words", "n_features", "bucket", "rows", "counts", "total"]
    types = [pa.int64(), kind, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        for batch in batches:
            first = 0
            sizes = pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            while first < len(batch):
                last, size = first + 1, int(sizes[first])
                while last < len(batch) and size + sizes[last] <= _SLICE:
                    size, last = size + int(sizes[last]), last + 1
                part = batch.slice(first, last - first)
                n, first = last - first, last
                of, word_of, bucket = features([t.as_py() for t in part.column(2)], buckets, most_words)
                n_words, n_features = np.bincount(word_of, minlength=n), np.bincount(of, minlength=n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(kind), pa.array(n_words), pa.array(n_features), *(pa.nulls(n, t) for t in types[4:])], names=names)
                key, count = np.unique(of * buckets + bucket, return_counts=True)
                held.append((part.column(0).to_numpy()[key // buckets], key % buckets, count))
                postings += len(key)
                if postings >= _HELD:
                    yield _blocks(held, names, types)
                    held, postings = [], 0
        if postings:
            yield _blocks(held, names, types)

    told = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {told}, n_words long, n_features long, bucket int, rows array<long>, counts array<int>, total long")


def _texts(df: DataFrame, key: str) -> DataFrame:
    """(row, doc_id, text as bytes); row tells rows apart from the moment that they are written."""
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), whole_text().cast("binary").alias("text"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for the buckets of source, from blocks (bucket, total) of both; at most a row for each bucket."""
    corpora = source.select("bucket", F.col("total").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("total").alias("t")))
    sums = corpora.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # a row of totals
    both = sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))
    up, down = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)), (F.col("s") + 1.0) * (F.col("all_t") + float(buckets))
    return both.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).cast("long").alias("gain"))


def weights(source: DataFrame, gains: DataFrame) -> DataFrame:
    """(row, weight) of blocks (bucket, rows, counts): blocks meet the gain of their bucket in SALTS parts, contributions are added up by row."""
    salted = source.withColumn("salt", F.pmod(F.xxhash64(F.element_at("rows", 1)), F.lit(SALTS)).cast("int"))
    spread = gains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(spread.hint("shuffle_hash"), ["bucket", "salt"])
    each = met.select(F.posexplode("rows").alias("at", "row"), "counts", "gain")
    return each.groupBy("row").agg(F.sum(F.get("counts", F.col("at")) * F.col("gain")).alias("weight"))


def _noise(seed: str):
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share))).cast("long")


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; rank is null where it isn't drawn.

    documents (doc_id, text, ...) and target (text, ...) may have further columns of any name.
    """
    index = materialise(inverted(_texts(documents, "doc_id"), buckets, most_words), "postings")
    wanted = target.withColumn("text", whole_text()).select("text").withColumn("id", F.lit(None).cast("long"))
    aim = materialise(inverted(_texts(wanted, "id"), buckets, most_words), "target-postings")
    blocks, held = index.where("bucket IS NOT NULL"), index.where("bucket IS NULL").select("row", "doc_id", "n_words", "n_features")
    gains = bucket_gains(blocks.select("bucket", "total"), aim.where("bucket IS NOT NULL"), buckets)
    scored = held.join(weights(blocks, gains), "row", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    scored = scored.withColumns({"score": F.col("weight") + _noise(seed), "drawable": F.col("n_words") >= least_words})
    ordered = scored.orderBy(F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "row")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = materialise(ordered.select("doc_id", "n_features", "weight", "score", "drawable", F.spark_partition_id().alias("part"), place.alias("place")), "ordered")
    discard(index, aim)
    # a row for each range of the sort
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.count_if("drawable").alias("drawable_n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"), F.floor(F.sum("drawable_n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * percent / 100).alias("most"))
    rank = (F.col("before") + F.col("place") + 1).cast("long")
    return ordered.join(broadcast_if_small(parts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("drawable") & (rank <= F.col("most")), rank).alias("rank"))
