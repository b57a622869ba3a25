"""An inverted index: postings sorted by term, and BM25 over the postings of a query's terms alone.

A posting (term, seq, tf, length, positions) is one term of one row: how often it is there, how many tokens the row has,
and where the term stands. Files are sorted by term, so a term is a place and a prefix a range that the Parquet scan
skips to by the statistics of row groups and pages. Postings are derived from texts and can be made anew at any time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from mnemolake.functions.slices import KNOWN, slices
from mnemolake.functions.stem import stems_of

POSTING = (("term", "string", None), ("seq", "long", None), ("tf", "int", None), ("length", "int", None), ("positions", "array<int>", None))
#: Postings of a file at about this many; more are sorted over ranges of terms.
FILE_POSTINGS = 1 << 20

_SHAPE = pa.struct([("length", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))])))])


def terms_of(text: Column, stemmed: bool = True) -> Column:
    """struct<length, terms: array<struct<term, positions>>> of a text; null has no tokens. Rows travel as Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for batch in slices(batches):
            if len(known) > KNOWN:
                known.clear()
            lengths, firsts, terms, starts, positions = [], [0], [], [0], []
            for value in batch:
                text, places = value.as_py() or "", {}
                tokens = stems_of(text, known) if stemmed else re.findall("[a-z0-9]+", text.lower())
                for i, t in enumerate(tokens):
                    places.setdefault(t, []).append(i)
                lengths.append(len(tokens))
                terms.extend(places)
                for at in places.values():
                    positions.extend(at)
                    starts.append(len(positions))
                firsts.append(len(terms))
            each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(positions, pa.int32()))], fields=list(_SHAPE[1].type.value_type))
            yield pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), each)], fields=list(_SHAPE))

    return F.arrow_udf(run, from_arrow_type(_SHAPE))(text)


def postings(rows: DataFrame, terms: str = "terms") -> DataFrame:
    """Postings of rows (seq, terms), in no order; a row without tokens has none."""
    each = rows.select("seq", F.col(f"{terms}.length").alias("length"), F.explode(f"{terms}.terms").alias("t"))
    return each.select(F.col("t.term").alias("term"), "seq", F.size("t.positions").alias("tf"), "length", F.col("t.positions").alias("positions"))


def ordered(found: DataFrame, n: int) -> DataFrame:
    """Postings in the order in which they are written; a frequent term is split by seq. n: how many there are."""
    files = -(-n // FILE_POSTINGS)
    dealt = found.repartitionByRange(files, "term", "seq") if files > 1 else found.coalesce(1)
    return dealt.sortWithinPartitions("term", "seq")


def _is(phrase: list[str], j: int) -> Column:
    """The last token of a phrase is a prefix, the others are whole."""
    return F.col("term").startswith(phrase[j]) if j == len(phrase) - 1 else F.col("term") == phrase[j]


def _back(positions: str, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def of_query(index: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """The postings of the query's terms; the condition reaches the scan."""
    tests = {(t, j == len(p) - 1): _is(p, j) for p in wanted for j, t in enumerate(p)}
    return index.where(reduce(lambda a, b: a | b, tests.values()))


def counts(found: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """(seq, length, f0, f1, ...): how often each phrase occurs in each row that holds any of the terms.

    Only a phrase of several tokens looks at positions: those of its j-th token are moved back by j and have to agree.
    """
    made, out = [F.max("length").alias("length")], []
    for i, phrase in enumerate(wanted):
        if len(phrase) == 1:
            made.append(F.sum(F.when(_is(phrase, 0), F.col("tf")).otherwise(0)).alias(f"f{i}"))
            out.append(F.col(f"f{i}"))
            continue
        for j in range(len(phrase)):
            made.append(F.flatten(F.collect_list(F.when(_is(phrase, j), _back("positions", j)))).alias(f"p{i}_{j}"))
        out.append(F.size(reduce(F.array_intersect, (F.col(f"p{i}_{j}") for j in range(len(phrase))))).cast("long").alias(f"f{i}"))
    return found.groupBy("seq").agg(*made).select("seq", "length", *out)
