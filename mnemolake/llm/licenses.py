"""License scans: canonical digest lookup.

A text's canonical form has lower-case letters, no copyright lines, one spelling for each of a list of words, and one
blank for every run of white space and punctuation. Its SHA-256 is hash-joined with the digests of known licences, a
fixed list and any that the caller has besides. The same lookup over a document's single lines finds one-line notices.

Defined results: null and empty texts have the digest of the empty text and no licence; texts of punctuation or
copyright lines alone too; equal texts give equal rows; repeated rows each get theirs; several licences of one
digest can't be, as the first known name of a digest stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import broadcast_if_small, whole_text
from mnemolake.llm.license_texts import LONG_TEXTS, NOTICES, TEXTS

#: A line that only names who holds copyright; lines end at \n alone.
COPYRIGHT_LINE = r"(?md)^[ \t\r*#/;-]*(copyright[ \t:]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*[0-9<\[{]|©|all rights reserved)[^\n]*$"
#: A word starts where no ASCII letter or digit is before it.
_START = r"(?<![a-z0-9])"
#: Fixed values: (spelling as a regular expression over the lower-cased text, the one kept).
SPELLINGS = (
    (_START + r"licenc", "licens"),
    (_START + r"sub-?licen[cs]", "sublicens"),
    (_START + r"non-infringement", "noninfringement"),
    (_START + r"non-commercial", "noncommercial"),
    (_START + r"organisation", "organization"),
    (_START + r"recognise", "recognize"),
    (_START + r"acknowledgement", "acknowledgment"),
    (_START + r"favour", "favor"),
    (_START + r"whilst(?![a-z0-9])", "while"),
    (_START + r"copyright owner", "copyright holder"),
    (_START + r"https:", "http:"),
)
#: Everything but ASCII letters and digits and non-ASCII characters, as a run.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Any text that a spelling rule can change has one of these, any with a copyright line one of those; others skip the rules.
_SPELLED = ("licenc", "sub-licens", "non-", "isation", "ognise", "edgement", "favour", "whilst", "copyright", "https:")
_CLAIMS = ("copyright", "(c)", "©", "all rights")
#: Characters beyond ASCII that lower() would change, though the canonical form keeps them.
_OTHER_CAPITAL = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
#: A line has to have one of these to be looked up; ASCII letters of either case.
_TELLS = r"(?i)licen[cs]e|released under"


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def _low(text: Column) -> Column:
    """A to Z in lower case and nothing else; the function for all letters is faster, where it gives the same."""
    same = (F.char_length(text) == F.octet_length(text)) | ~text.rlike(_OTHER_CAPITAL)
    return F.when(same, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _unclaimed(low: Column) -> Column:
    return F.when(_any_of(low, _CLAIMS), F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low)


def _spelled(kept: Column) -> Column:
    spelled = kept
    for pattern, one in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, one)
    return F.when(_any_of(kept, _SPELLED), spelled).otherwise(kept)


def _spaced(spelled: Column) -> Column:
    return F.btrim(F.regexp_replace(spelled, SEPARATORS, " "))


def canonical(text: Column) -> Column:
    return _spaced(_spelled(_unclaimed(_low(text))))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS + LONG_TEXTS) -> DataFrame:
    """(known, license): a row for each known digest; as many as the fixed list has."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "i int, name string, text string")
    return rows.groupBy(digest(F.col("text")).alias("known")).agg(F.min_by("name", "i").alias("license"))


def scan_licenses(documents: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row for each row of documents: doc_id, digest, license (of the entire text), notices (of lines, sorted), n_notices.

    more has further known texts (license, text); of one digest the fixed list's name stands, else the smallest.
    """
    spark = documents.sparkSession
    notices = F.create_map(*(x for row in known_digests(spark, NOTICES).collect() for x in (F.lit(row.known), F.lit(row.license))))
    # a step is a column of its own, so that the next one, which reads it several times, doesn't compute it again
    rows = documents.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", "text", _low(F.col("text")).alias("low")).select("doc_id", "text", _unclaimed(F.col("low")).alias("kept"))
    rows = rows.select("doc_id", F.sha2(_spaced(_spelled(F.col("kept"))), 256).alias("digest"), F.when(F.col("text").rlike(_TELLS), F.filter(F.split("text", "\n"), lambda x: x.rlike(_TELLS))).otherwise(F.array().cast("array<string>")).alias("lines"))
    rows = rows.select("doc_id", "digest", F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: notices[digest(x)]), lambda x: x.isNotNull()))).alias("found"))
    rows = rows.select("doc_id", "digest", F.array_join("found", ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))
    known = F.broadcast(known_digests(spark))
    if more is not None:
        own = more.groupBy(digest(whole_text()).alias("known")).agg(F.min("license").alias("license"))
        known = own.join(known.select("known"), "known", "left_anti").unionByName(known_digests(spark))
        known = broadcast_if_small(known)
    return rows.join(known, F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "license", "notices", "n_notices")
