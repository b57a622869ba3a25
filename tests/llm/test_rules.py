"""One rule in three engines, hot ids, hostile blobs, and what is left behind."""

import io
import random
import re
import time
import zipfile

import duckdb
import pytest

pytest.importorskip("mnemolake.llm")

from mnemolake.llm import decontaminate, licenses, media, mixing, oracles  # noqa: E402
from mnemolake.llm.license_texts import LONG_TEXTS, TEXTS  # noqa: E402

PIECES = ["copyright (c) 2020 a", "Copyright: 2020", "© x", "(c) 1999 b", "all rights reserved.", "licence", "élicence", "Licencé", "sub-licence", "sublicencing", "whilst", "whilst whilst", "awhilst", "favour", "https://x", "non-commercial", "_licence", "9licence", "word", "É", "organisation", "recognised", "acknowledgements", "copyright owner", "Licensed under the MIT License"]
ENDS = ["\n", "\r", "\r\n", "\u0085", " ", " ", "", "é", ".", "\t", "-"]


def test_licence_rules_are_one_in_three_engines(spark, docs):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) + rng.choice(ENDS) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts += [t for _, t in TEXTS + LONG_TEXTS] + [t.upper().replace("\n", "\r\n") for _, t in TEXTS + LONG_TEXTS] + ["", None]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(list(enumerate(texts)))).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {r[0]: r for r in db.execute(oracles.license_sql()).fetchall()}
    names = [c[0] for c in db.description]
    assert len(got) == len(want) == len(texts)
    for i, row in want.items():
        assert got[i].asDict() == dict(zip(names, row, strict=True)), texts[i]
    import hashlib

    assert all(got[i].digest == hashlib.sha256(oracles.canonical(t or "").encode()).hexdigest() for i, t in enumerate(texts))
    first = len(texts) - 2 - 2 * len(TEXTS + LONG_TEXTS)
    assert all(got[i].license for i in range(first, len(texts) - 2))


def test_one_id_of_many_rows_is_spread(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 64)
    rows = [(None, "a b c", "s")] * 3000 + [(None, "a b c d", "s")] * 500 + [(n, "x " * (n % 9), "st"[n % 2]) for n in range(2000)]
    sized = mixing._sized(docs(rows), "mix")
    started = mixing._started(sized)
    plain, sums = [], {}
    for r in sorted(sized.collect(), key=lambda r: (r.source, r.part, r.place, r.doc_id is not None, r.doc_id or 0, r["size"])):
        at = sums.get((r.source, r.part), 0)
        plain.append((r.source, r.part, r.doc_id, r["size"], at))
        sums[r.source, r.part] = at + r["size"]
    assert sorted(map(tuple, started.collect()), key=str) == sorted(plain, key=str)


def test_hostile_blobs_take_linear_time():
    for blob in (b"PK\3\4" * 60_000 + b"PK\5\6" * 60_000, b"%PDF-1.4 startxref" * 60_000, b"%PDF-1.4 %%EOF" * 60_000, b"PK\3\4" + b"PK\5\6" * 100_000 + b"\0" * 30):
        began = time.time()
        media.sniff(blob)
        assert time.time() - began < 3
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", "text")
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    blob = b"PK\5\6" + held.getvalue() + b"PK\5\6" + pdf + held.getvalue()
    assert [(k, blob[a : a + n]) for k, a, n in media.sniff(blob)[0]] == [("application/zip", held.getvalue()), ("application/pdf", pdf), ("application/zip", held.getvalue())]


def test_decontamination_leaves_what_its_result_reads(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr("mnemolake.work.shared_dir", lambda _: f"file://{tmp_path}")
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.contamination(docs([(1, f"a {item} b"), (2, "nothing")]), bench)
    assert [r.n_hit for r in found.orderBy("doc_id").collect()] == [20, 0]
    assert sorted(re.sub("-[0-9a-f]{32}$", "", p.name) for p in tmp_path.iterdir()) == ["scanned", "verdicts"]


def test_probes_wrap_without_a_warning(recwarn):
    import numpy as np

    s = np.arange(5, dtype=np.uint64)
    assert len(decontaminate._probes(s, 1000, 1, 20)) == 5 and not recwarn.list
