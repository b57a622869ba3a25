import zlib

import pytest

pytest.importorskip("mnemolake.llm")

from mnemolake.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tests.oracle import DATA, connect, same  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name,label,fold,least", [("op6_toxicity", "toxic", (5, 0), 0.8), ("op9_quality", "quality", (3, 1), 0.9)])
def test_held_out_accuracy(spark, name, label, fold, least):
    got = {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}
    labels = dict(connect().execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    held = [i for i in labels if i in got and zlib.crc32(str(i).encode()) % fold[0] == fold[1]]
    assert all(got[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) >= least
