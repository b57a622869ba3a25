"""Ranking: cosine, BM25 with prefix phrases, their normalisation and the hybrid of both with importance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.embed import embed
from mnemolake.functions.exprs import cosine, not_archived, search_text, ttl_live, vector
from mnemolake.functions.stem import plain_tokens, stems, stems_of

COSINE_WEIGHT, TEXT_WEIGHT, IMPORTANCE_WEIGHT = 0.6, 0.2, 0.2
K1, B = 1.2, 0.75


def visible(memories: DataFrame, now: int | None, include_archived: bool = False) -> DataFrame:
    """Rows that searches see: within their ttl at epoch second `now` (None: no ttl filter), not archived."""
    if now is not None:
        memories = memories.where(ttl_live(now))
    return memories if include_archived else memories.where(not_archived())


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine; a bounded heap in each task, no full sort."""
    scored = vectors.select(key, cosine(F.col(column), vector(query)).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), key).limit(k)


def phrases(query: str, stemmed: bool = True) -> list[list[str]]:
    """Each word of the query is a phrase whose last token is a prefix; an underscore separates tokens of one phrase."""
    words = re.findall(r"\w+", query.lower())
    split = [stems_of(w) if stemmed else re.findall("[a-z0-9]+", w) for w in words]
    return [p for p in split if p]


def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(phrase[0])))

    def at(i: Column) -> Column:
        hit = F.get(tokens, i + (len(phrase) - 1)).startswith(phrase[-1])
        for n, word in enumerate(phrase[:-1]):
            hit = hit & (F.get(tokens, i + n) == word)
        return hit

    places = F.when(F.size(tokens) >= len(phrase), F.sequence(F.lit(0), F.size(tokens) - len(phrase))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, at))


def tokens_of(text: Column, stemmed: bool = True) -> Column:
    return stems(text) if stemmed else plain_tokens(text)


def index(memories: DataFrame, key: str = "id", text: str = "fact_text", stemmed: bool = True) -> DataFrame:
    """(key, tokens): derived and rebuildable. Every row is in it, those without text too."""
    return memories.select(key, tokens_of(F.col(text), stemmed).alias("tokens"))


def _counts(wanted: list[list[str]]) -> list[Column]:
    return [F.size("tokens").alias("length"), *(_occurrences(F.col("tokens"), p).alias(f"f{i}") for i, p in enumerate(wanted))]


def _corpus(counted: DataFrame, n: int) -> DataFrame:
    """One row of statistics, so it is broadcast."""
    return F.broadcast(counted.agg(F.count("*").alias("rows"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n))))


def _bm25(n: int) -> Column:
    """Of counts beside the corpus statistics; null where a phrase is absent."""
    score = F.lit(0.0)
    for i in range(n):
        f, held = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.ln((F.col("rows") - held + 0.5) / (held + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return F.when(F.expr(" AND ".join(f"f{i} > 0" for i in range(n))), -score)


def bm25(indexed: DataFrame, query: str, key: str = "id", stemmed: bool = True) -> DataFrame:
    """(key, bm25), lower is better, for rows that hold all phrases."""
    wanted = phrases(query, stemmed)
    if not wanted:
        return indexed.select(key, F.lit(0.0).alias("bm25")).limit(0)
    counted = indexed.select(key, *_counts(wanted))
    return counted.join(_corpus(counted, len(wanted))).select(key, _bm25(len(wanted)).alias("bm25")).where("bm25 IS NOT NULL")


def bm25_of_counts(counted: DataFrame, n: int, rows: int, mean: float, key: str = "seq") -> DataFrame:
    """(key, bm25) of counts (key, length, f0, ...) of the rows that hold any of n phrases; rows and mean are of all rows there are."""
    # length is asked for so that both sides need the same columns, and one exchange serves both
    held = F.broadcast(counted.agg(*(F.count_if((F.col(f"f{i}") > 0) & (F.col("length") > 0)).alias(f"n{i}") for i in range(n))))
    both = counted.join(held).withColumns({"rows": F.lit(rows), "mean": F.lit(float(mean))})
    return both.select(key, _bm25(n).alias("bm25")).where("bm25 IS NOT NULL")


def _ends(scores: DataFrame) -> DataFrame:
    return F.broadcast(scores.agg(F.min("bm25").alias("best"), F.max("bm25").alias("worst")))


def _text_score() -> Column:
    return F.when(F.col("best") == F.col("worst"), F.lit(1.0)).otherwise(1 - (F.col("bm25") - F.col("best")) / (F.col("worst") - F.col("best")))


def normalised(scores: DataFrame, key: str = "id") -> DataFrame:
    """(key, text_score): 1 for the best, 0 for the worst, 1 for all where they are equal."""
    return scores.join(_ends(scores)).select(key, _text_score().alias("text_score"))


def hybrid(memories: DataFrame, query: str, k: int = 5, now: int | None = None, include_archived: bool = False, stemmed: bool = True, query_vector: list[float] | None = None) -> DataFrame:
    """The k best rows: id, identifier, content, created_at, cosine, text_score, score, rank. Rows without text are no candidates.

    The statistics cover all rows, also those that the search doesn't show, so they don't change with time. This is the
    search without an index: tokens are counted where they lie (in `tokens` where memories have that column).
    """
    wanted = phrases(query, stemmed)
    held = memories if stemmed and "tokens" in memories.columns else memories.withColumn("tokens", tokens_of(F.col("fact_text"), stemmed))
    shown = F.lit(True)
    if now is not None:
        shown = shown & ttl_live(now)
    if not include_archived:
        shown = shown & not_archived()
    counted = held.select(*_shape(query, query_vector), shown.alias("shown"), *_counts(wanted))
    if not wanted:
        return _ranked(counted.where("shown"), False, k)
    return _ranked(counted.where("shown").join(_corpus(counted, len(wanted))).withColumn("bm25", _bm25(len(wanted))), True, k)


def hybrid_of_scores(memories: DataFrame, scores: DataFrame | None, query: str, k: int = 5, now: int | None = None, include_archived: bool = False, query_vector: list[float] | None = None) -> DataFrame:
    """hybrid() where an index gave the scores (seq, bm25) of all rows that the query matches; None: it has no words."""
    rows = visible(memories, now, include_archived).select("seq", *_shape(query, query_vector))
    return _ranked(rows if scores is None else rows.join(scores, "seq", "left"), scores is not None, k)


def _shape(query: str, query_vector: list[float] | None) -> list:
    near = cosine(F.col("embedding"), vector(query_vector or embed(query))).alias("cosine")
    return ["id", "identifier", "source", search_text().alias("content"), "created_at", "importance", near]


def _ranked(rows: DataFrame, matched: bool, k: int) -> DataFrame:
    """The k best of rows with cosine and, if any text is matched, bm25."""
    if matched:
        rows = rows.join(_ends(rows)).withColumn("text_score", F.coalesce(F.when(F.col("bm25").isNotNull(), _text_score()), F.lit(0.0)))
    else:
        rows = rows.withColumn("text_score", F.lit(0.0))
    score = F.lit(COSINE_WEIGHT) * F.col("cosine") + F.lit(TEXT_WEIGHT) * F.col("text_score") + F.lit(IMPORTANCE_WEIGHT) * F.col("importance")
    shape = ("id", "identifier", "source", "content", "created_at", "importance", "cosine", "text_score")
    top = rows.where("content IS NOT NULL").select(*shape, score.alias("score")).orderBy(F.desc("score"), F.desc("cosine"), "id").limit(k)
    # a window over the k rows alone
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc("cosine"), "id")))


def budgeted(ranked: DataFrame, max_chars: int) -> DataFrame:
    """Contents of a ranked result cut to a running budget of characters; rows beyond it go."""
    before = F.coalesce(F.sum(F.char_length("content")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("left", F.lit(max_chars) - before).where("left > 0")
    return rows.withColumn("content", F.substr("content", F.lit(1), F.col("left").cast("int"))).drop("left")


def messages(ranked: DataFrame) -> DataFrame:
    """The shape that searches return."""
    return ranked.select(F.lit("system").alias("role"), "content", F.col("id").alias("memory_id"), "identifier", F.round("score", 4).alias("score"), "created_at", "rank")


def context_block(ranked: DataFrame, header: str = "Relevant memories:") -> DataFrame:
    """One row: the contents as a list under a header, or the empty text. `ranked` has k rows."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("- "), x["content"]))
    return ranked.agg(F.when(F.count("*") > 0, F.concat(F.lit(header + "\n"), F.array_join(lines, "\n"))).otherwise("").alias("context"))
