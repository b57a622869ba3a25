import gzip
import hashlib
import html as entities
import random
import re
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("mnemolake.llm")

from mnemolake.llm import chat, common, components, decontaminate, html, licenses, media, mixing, near_duplicates, pii, quality, toxicity, training, words  # noqa: E402
from mnemolake.llm.license_texts import TEXTS  # noqa: E402
from tests.oracle import DATA, connect  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_words_equal_the_pattern(text):
    raw = words.raw_bytes(text)
    starts, ends = words.spans(raw)
    assert [w.decode("utf-8", "surrogatepass") for w in words.word_list(raw, starts, ends)] == plain_words(text)


# media


def _png():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    png, gz, wav = _png(), gzip.compress(b"text"), media.to_wav(b"\1\2" * 8)
    blob = b"BM no bitmap PK\x03\x04" + png + b"..." + wav + b"RIFF" + gz
    found, rejected = media.sniff(blob)
    assert [(k, blob[a : a + n]) for k, a, n in found] == [("image/png", png), ("audio/wav", wav), ("application/gzip", gz)] and rejected == 3
    df = spark.createDataFrame([(png, "image/gif"), (None, "x/y"), (b"", None), (blob, "a/b")], "b binary, d string")
    got = [r[0] for r in df.select(media.sniff_media(df.b, df.d)).collect()]
    assert [(g.detected, g.corrected, len(g.carved)) for g in got] == [("image/png", True, 0), ("x/y", False, 0), (None, False, 0), ("a/b", False, 3)]
    assert media.sniff(png[:-4] + b"\0\0\0\0")[0] == []


def test_media_round_trip(docs):
    rows = [(1, None), (2, ""), (3, "a" * 576), (4, "é" * 300), (4, "é" * 300), (None, LONG)]
    got = media.media_features(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((a, b) for a, b in rows)[r.doc_id] or ""
        payload = text.encode() + b"\xff" * (max(576, -(-len(text.encode()) // 576) * 576) - len(text.encode()))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.media_features(docs([])).count() == 0


# mixing


def test_mix_keeps_targets_and_limits(docs):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), None if i % 9 == 8 else f"s{i % 9}" if i % 3 else "hot") for i in range(900)] + [(1, None, "empty"), (5, "a b", "s1"), (5, "a b", "s1")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(rows)).collect()))
    total, sums = sum(r["size"] for r in got), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = sums.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    assert abs(sum(s[1] for s in sums.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * n + 1e-9 and abs(got - t) <= 0.02 * t + 4 for got, t, n in sums.values())
    assert mixing.mix(docs([])).count() == 0 and mixing.mix(docs([(1, None)])).first().taken == 0


def test_shards_take_their_quotas_of_blocks(docs):
    """Each shard's words of a source are the next blocks in the seeded order, as many as the highest quotients say."""
    rows = [(i, " ".join(["w"] * (i * 7 % 61)), None if i % 9 == 8 else f"s{i % 9 % 4}") for i in range(700)]
    got, total = mixing.mix(docs(rows), shards=5).collect(), sum(i * 7 % 61 for i in range(700))
    block, sources = got[0].block, sorted({(r.source is None, r.source or "", r.source_size, r.target) for r in got})
    won = sorted((-t / (2 * k - 1), rank, k) for rank, (*_, n, t) in enumerate(sources) for k in range(1, 2 * -(-n // block) + 1))
    seats = int(1.5 * total // block)
    for rank, (null, name, n, _) in enumerate(sources):
        held = [sum(q[1] == rank for q in won[: seats * j // 5]) for j in range(6)]
        own = sorted((hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:15], r.doc_id, r) for r in got if (r.source is None, r.source or "") == (null, name))
        start, blocks = 0, -(-n // block)
        for _, _, r in own:
            want = {}
            for word in range(start, start + r["size"]):
                for turn in range(2):
                    seat = turn * blocks + word // block
                    if seat < held[5]:
                        shard = next(j for j in range(1, 6) if seat < held[j])
                        want[shard] = want.get(shard, 0) + 1
            assert {x.shard: x.words for x in r.shards} == want and r.taken == sum(want.values())
            start += r["size"]


def test_shard_quotas_are_highest_quotients(spark):
    sizes = [("a", 70000), ("b", 51), ("c", 9000), ("d", 333), ("e", 4100), (None, 7)]
    targets = mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).cache()
    by_rank = {r["rank"]: r for r in targets.collect()}
    got = mixing.shard_quotas(targets, 5).collect()
    block = got[0].block
    for shard in range(1, 6):
        seats = int(sum(n for _, n in sizes) * 1.5 // block) * shard // 5
        most = {k: 2 * -(-r.source_size // block) for k, r in by_rank.items()}
        quotients = sorted(((-r.target / (2 * k - 1), rank, k) for rank, r in by_rank.items() for k in range(1, most[rank] + 1)))[:seats]
        want = {rank: sum(q[1] == rank for q in quotients) for rank in by_rank}
        assert {r["rank"]: r.held for r in got if r.shard == shard} == want


# chat


def test_chat_reads_back(spark):
    odd = "\\### <turn>x</turn>\n\\b\\h \\\\ é"
    rows = [(1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, None, "x"), (3, None, "a\nb", "y"), (4, 0, "user", LONG), (4, 1, "user", "again"), (4, 1, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS segments")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("back", chat.read_back(chat.F.col("formatted"))).withColumn("loss", chat.loss_text(chat.F.col("back"), chat.F.col("segments"))).collect()}
    for conv, r in out.items():
        want = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(x.role, x.text) for x in r.back] == [(b, c) for _, b, c in want]
        assert r.loss == "".join(c for _, b, c in want if b == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert [(out[i].valid, out[i].first_bad_turn) for i in (1, 2, 3, 4)] == [(True, None), (True, None), (False, 0), (False, 1)]
    assert chat.conversation_digests(df.limit(0)).count() == 0


# decontamination


def brute_contamination(text, items):
    w = plain_words(text)
    hit, ids = set(), set()
    for item, body in items:
        b = plain_words(body)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[i : i + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bits", [decontaminate.MOST_BITS, 16])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    if bits == 16:
        monkeypatch.setattr(decontaminate, "PROBES", 1)
    passage = " ".join(f"k{i}" for i in range(20))
    many = " ".join(f"m{i} of the" for i in range(90))
    items = [(1, passage), (2, "short one"), (3, "the the the the the"), (4, ""), (5, None), (6, "solo"), (1, passage + " more"), (10, "short one"), (None, "four words make one"), (11, many), (12, "É ÀB cd ΑΒ")]
    rows = [(0, None), (1, ""), (2, f"x {passage.upper()} y"), (3, "a Short, one! short one"), (4, "the " * 30), (5, LONG), (6, passage[:40]), (7, "solo"), (8, f"{passage} {passage}"), (9, " ".join(["pad"] * 400) + " solo"), (7, "solo")]
    rows += [(12, many), (13, "x " * 60 + many), (14, many.replace("m40 ", "")), (15, "four words make one four words make"), (16, "É àb CD ΑΒ"), (17, "É ÀB cd αβ"), (18, passage[3:]), (19, "pad " * 57 + passage + " pad" * 70 + " " + passage)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS s", "2 AS k")
    got = decontaminate.contamination(docs(rows), bench).collect()
    want = [(i, *brute_contamination(t, [("" if a is None else a, b) for a, b in items])) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    kept = decontaminate.decontaminate(docs(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[-1]) and kept.columns == docs(rows).columns
    assert decontaminate.decontaminate(docs(rows), bench.limit(0)).count() == len(rows)


# HTML


def test_html_main_text(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert html.main_text(r.html) == "\n".join(b for b in blocks if b)
    page = "<body><div class='top-nav'><a>Home</a></div><div id=c><h2>T &eacute;</h2><p>A long\n  paragraph of the article that is read.<p>Short.<div class=comments><p>me too</div></div><footer>f</footer>"
    assert html.main_text(page) == "T é\nA long paragraph of the article that is read.\nShort."
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<<<p"), (4, "<p>" * 3000 + "x"), (5, "just text")], "page_id long, html string").selectExpr("*", "'u' AS url", "0 AS n_chars")
    assert [(r.page_id, r.text, r.n_chars) for r in html.extract_pages(df).collect()][0] == (1, "", 0)
    assert html.extract_pages(df).count() == 5 and html.main_text("just text") == "just text"


_STORY = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i} of a story that is long enough to be read by anyone who likes it.</p>" for i in range(4))
_TOLD = "\n".join(["Title", *(f"Paragraph {i} of a story that is long enough to be read by anyone who likes it." for i in range(4))])


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content-sidebar-wrap'><article>{_STORY}</article></div><div class=sidebar><p>Other</p></div>",
        f"<body><div class='layout has-sidebar'><main>{_STORY}</main><div class='left-sidebar'><p>Other</p></div></div>",
        f"<body class=x><div id=no-sidebar><div id=c>{_STORY}</div></div>",
        f"<body><article class='post category-notices'>{_STORY}<div class='article-comments'><p>me too</p></div></article>",
        f"<body><div class='sidebar-layout'><article>{_STORY}</article></div>",
        f"<body><main>{_STORY}<div class=related><article><p>A teaser.</p></article></div></main>",
        f"<body><main>{_STORY}</main><div class=related><article><p>A teaser.</p></article></div>",
    ],
)
def test_wrappers_named_after_what_surrounds_keep_their_article(page):
    assert html.main_text(page) == _TOLD


def test_article_lines_of_links_stay_without_an_article_element():
    assert html.main_text(f"<body><div id=c>{_STORY}<p>See <a href=x>the whole report of the committee</a>.</p></div>") == _TOLD + "\nSee the whole report of the committee."


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>Text of article <button>Share</button> goes on</p></article>", "Text of article goes on"),
        ("<article><p>Text <span class='advert'>Buy now</span> more</p></article>", "Text more"),
        ("<article><p>Text <select><option>one<option>two</select> <textarea>three</textarea><noscript>four</noscript>more</p></article>", "Text more"),
        (f"<article>{_STORY}<p class='notice-period'>The notice period.</p></article>", _TOLD + "\nThe notice period."),
        (f"<article>{_STORY}<section class='related-work'><p>Earlier work.</p></section></article>", _TOLD + "\nEarlier work."),
        (f"<body><div id=c>{_STORY}<p><a href=x>A link alone</a></p></div>", _TOLD + "\nA link alone"),
        (f"<body><div class=header><p>Our site</div><div class=content>{_STORY}<div class='cookie-notice'>We use cookies</div></div><div class='ad-box'>Buy</div>", _TOLD),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ],
)
def test_what_surrounds_goes_and_nothing_else(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("named", ["class='adsbygoogle'", "id='google_ads_1'", "data-ad", "data-ad-slot='3'", "class='outbrain'", "role='alert'", "class='sponsor-message'", "class=ad", "class='ad-slot'"])
def test_adverts_and_notices_in_an_article_go(named):
    assert html.main_text(f"<article>{_STORY}<div {named}>Buy now</div></article>") == _TOLD


def test_a_paragraph_that_is_no_advert_stays():
    assert html.main_text(f"<article>{_STORY}<p class='ad-free-note'>This page is free.</p></article>") == _TOLD + "\nThis page is free."


def _flattened(page):
    return re.sub(r"</?(article|nav)[^>]*>", "", page)


def test_ratios_select_lines_of_pages_without_article_and_nav(spark, monkeypatch):
    """The pages of the test data without those tags: the article without the menu; ratios that say nothing keep the menu."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert len(pages) == 250
    told = [html.main_text(p) for p in pages]
    assert [html.main_text(_flattened(p)) for p in pages] == told
    monkeypatch.setattr(html, "_ratios", lambda lines: np.zeros(len(lines)))
    assert sum(html.main_text(_flattened(p)) != t for p, t in zip(pages, told, strict=True)) == 250


def test_links_in_a_row_stay_where_there_is_nothing_else():
    links = "".join(f"<li><a href=x>Link {i}</a>" for i in range(6))
    assert html.main_text(f"<body><ul>{links}</ul>").count("Link") == 6
    assert html.main_text(f"<body><ul>{links}</ul><div>{_STORY}<p><a href=x>One</a><p><a href=x>Two</a></div>") == _TOLD + "\nOne\nTwo"
    assert html.main_text(f"<body><article>{_STORY}<ul>{links}</ul></article>").count("Link") == 6


_TAGGED = "".join(f"<li><b><i>w{i}</i></b></li>" for i in range(100, 520))


@pytest.mark.parametrize("page", [f"<body><article><ul>{_TAGGED}</ul></article><article>{_STORY}</article>", f"<body><div><ul>{_TAGGED}</ul></div><div>{_STORY}</div>", f"<body><main><ul>{_TAGGED}</ul></main><div>{_STORY}</div>"])
def test_ratios_decide_the_region(page, monkeypatch):
    """Where the ratios say nothing, what has more text is selected instead of the story."""
    assert html.main_text(page) == _TOLD
    monkeypatch.setattr(html, "_ratios", lambda lines: np.zeros(len(lines)))
    assert html.main_text(page).startswith("w100\n") and "Paragraph" not in html.main_text(page)


@pytest.mark.parametrize("page", ["<b>" * 40_000 + "</p>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<div>" * 40_000 + "x" + "</div>" * 40_000, "<ul><li>x" * 20_000, "<div><article><p>x" * 20_000, "<td>" * 40_000])
def test_broken_markup_takes_linear_time(page):
    begin = time.process_time()
    html.main_text(page)
    assert time.process_time() - begin < 5


# personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(map(str.isdigit, m)) <= 19 and pii._luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(map(str.isdigit, m)) <= 15),
}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+- (5)0é|", max_size=60))
def test_base_spans_equal_the_patterns(text):
    for kind, (pattern, good) in BASE.items():
        assert pii.find_base(text)[kind] == [m.span() for m in re.finditer(pattern, text) if good(m[0])]


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("to joe (at) ex [dot] com.", "email", "joe (at) ex [dot] com"),
        ("to joe at ex dot com", "email", "joe at ex dot com"),
        ("ＪＯＥ＠ｅｘ．com", "email", "ＪＯＥ＠ｅｘ．com"),
        ("jоe@ex.com", "email", "jоe@ex.com"),
        ("ring plus four nine one seven six five five five", "phone", "plus four nine one seven six five five five"),
        ("jo​e@ex.com", "email", "jo​e@ex.com"),
    ],
)
def test_disguises_map_back(text, kind, span):
    _, every = pii.find_all(text)
    assert span in [text[a:b] for a, b in every[kind]]


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("host one nine two dot one six eight dot one dot five is up", "ip", "one nine two dot one six eight dot one dot five"),
        ("host 192 dot 168 dot 1 dot 5.", "ip", "192 dot 168 dot 1 dot 5"),
        ("host one nine two.168.one.5", "ip", "one nine two.168.one.5"),
        ("ring +49 one seven zero 5551234 now", "phone", "+49 one seven zero 5551234"),
        ("ring plus 49 one seven zero 5551234 now", "phone", "plus 49 one seven zero 5551234"),
        ("card four one one one 1111 1111 1111, thanks", "card", "four one one one 1111 1111 1111"),
        ("to joe at mail.ex dot com", "email", "joe at mail.ex dot com"),
        ("to joe @ ex.com", "email", "joe @ ex.com"),
        ("john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("write me at john dot a dot doe at example dot com, please", "email", "john dot a dot doe at example dot com"),
        ("write john dot doe (at) example (dot) com", "email", "doe (at) example (dot) com"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_numbers_that_mix_words_and_digits(text, kind, span):
    base, every = pii.find_all(text)
    assert [text[a:b] for a, b in every[kind]] == [span] and pii.mask(text, every) == text.replace(span, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["two or three of the 12 dogs", "one dot two dot three", "three point 5 million 200 people", "four one one one 1111 1111 1112", "one two 300 dot 400 dot 500 dot 600", "look at example.com"])
def test_numbers_that_no_detector_takes(text):
    assert not any(pii.find_all(text)[1].values())


@pytest.mark.parametrize("text", [" " * 1_000_000 + "(", "( " * 300_000, "a dot " * 200_000, "a at " * 200_000, "one " * 200_000, "+1 " * 200_000, "1 " * 300_000, "1." * 300_000, "plus " * 200_000, "a@" * 300_000, "[" * 500_000, "a" + " " * 500_000 + "@", "x dot" + " " * 400_000 + "at " * 9, "é1 " * 200_000])
def test_long_runs_take_linear_time(text):
    begin = time.process_time()
    pii.find_all(text)
    assert time.process_time() - begin < 10


WORDS_OF_DIGITS = "zero one two three four five six seven eight nine".split()


def plain_readings(text):
    """The text with each disguise undone in the plainest way, and the source range of each character; one kind of disguise at a time."""
    rules = [(r"(?i) *[\[(] *at *[\])] *", "@"), (r"(?i) *[\[(] *dot *[\])] *", "."), (r"(?i)(?<=[a-z0-9]) +at +(?=[a-z0-9-]+ +dot )", "@"), (r"(?i)(?<=[a-z0-9]) +dot +(?=[a-z0-9])", "."), (rf" *\b(?:{'|'.join(WORDS_OF_DIGITS)})\b", None)]
    chars = [(c, i, i + 1) for i, c in enumerate(text)]
    for pattern, new in rules:
        out, p = [], 0
        for m in re.finditer(pattern, "".join(c for c, _, _ in chars)):
            out += chars[p : m.start()]
            word = m[0].strip()
            # blanks before a number word go where a digit is before them
            lead = m.end() - len(word) if new is None and not (out and out[-1][0].isdigit()) else m.start()
            first = m.end() - len(word) if new is None else m.start()
            out += chars[m.start() : lead] + [(new or str(WORDS_OF_DIGITS.index(word)), chars[first][1], chars[m.end() - 1][2])]
            p = m.end()
        chars = out + chars[p:]
    return chars


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_added_spans_equal_a_plain_reading(data):
    """Texts of words, each with one disguised identifier: the added span is the one that the plain reading and the base patterns give."""
    word = st.sampled_from("lorem ipsum dolor amet sit".split())
    before, after = (" ".join(data.draw(st.lists(word, min_size=1, max_size=5))) for _ in "ab")
    kind = data.draw(st.sampled_from(["bracketed", "spoken", "phone", "ip"]))
    name, host = data.draw(st.sampled_from(["joe", "a.b", "x1"])), data.draw(st.sampled_from(["ex", "mail", "my-host"]))
    digits = data.draw(st.lists(st.integers(0, 9), min_size=9, max_size=12))
    said = {
        "bracketed": f"{name} [at] {host} (dot) org",
        "spoken": f"{name} at {host} dot org",
        "phone": "+" + str(digits[0]) + "".join(" " + WORDS_OF_DIGITS[d] for d in digits[1:]),
        "ip": " dot ".join(" ".join(WORDS_OF_DIGITS[d] for d in digits[2 * i : 2 * i + 2]) for i in range(4)),
    }[kind]
    text = f"{before} {said} {after}"
    chars = plain_readings(text)
    reading, of = "".join(c for c, _, _ in chars), {"phone": "phone", "ip": "ip"}.get(kind, "email")
    pattern, good = BASE[of]
    want = [(chars[m.start()][1], chars[m.end() - 1][2]) for m in re.finditer(pattern, reading) if good(m[0])]
    assert [text[a:b] for a, b in want] == [said] and pii.find_all(text)[1][of] == want


def test_many_spans_and_one_disguise():
    text = " ".join(f"u{i}@h.example" for i in range(40_000)) + " last [at] h.example"
    base, every = pii.find_all(text)
    assert len(base["email"]) == 40_000 and every["email"][:-1] == base["email"] and text[slice(*every["email"][-1])] == "last [at] h.example"


def test_pii_rows(docs):
    rows = [(1, None), (2, ""), (3, "a@b.cd and a@b.cd"), (3, "a@b.cd and a@b.cd"), (4, "1" * 50_000), (5, "@" * 3000), (None, LONG)]
    got = pii.scan_personal_data(docs(rows)).collect()
    assert len(got) == len(rows) and [r.spans for r in got if r.doc_id == 3] == ["email:0:6,email:11:17"] * 2
    assert pii.mask("a@b.cd +1 555 555 5555", pii.find_all("a@b.cd +1 555 555 5555")[1]) == "[EMAIL] [PHONE]"
    assert pii.scan_personal_data(docs([])).count() == 0


# near duplicates


def plain_kmers(text):
    """(k-mer, how often it came before) in order, written without the operator."""
    w, seen, out = plain_words(text), {}, []
    for i in range(max(1, len(w) - 4) if w else 0):
        kmer = tuple(w[i : i + 5])
        out.append((kmer, seen.get(kmer, 0)))
        seen[kmer] = seen.get(kmer, 0) + 1
    return out


def whole_chain(x, y):
    """How many of two lists are equal in the order of both, row by row of the whole matrix."""
    number = {w: i for i, w in enumerate(dict.fromkeys([*x, *y]))}
    a, b = [number[w] for w in x], np.array([number[w] for w in y], dtype=np.int64)
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0)))
    return int(row[-1])


def plain_similarity(x, y):
    """Of two texts, by their words."""
    x, y = plain_words(x), plain_words(y)
    m = whole_chain(x, y)
    return m / (len(x) + len(y) - m) if x or y else 0.0


def brute_links(texts):
    """Pairs of places in texts that are links; pairs that share no k-mer aren't looked at."""
    shapes, holders, links = [plain_kmers(t) for t in texts], {}, []
    for i, shape in enumerate(shapes):
        common = {}
        for k in shape:
            for j in holders.setdefault(k, []):
                common[j] = common.get(j, 0) + 1
            holders[k].append(i)
        for j, n in common.items():
            if n / (len(shape) + len(shapes[j]) - n) >= 0.25 and plain_similarity(texts[i], texts[j]) >= 0.8:
                links.append((j, i))
    return links


def brute_classes(rows):
    texts = sorted({t or "" for _, t, *_ in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, j in brute_links(texts):
        parent[root(texts[i])] = root(texts[j])
    ids = {}
    for i, t, *_ in rows:
        if i is not None:
            ids[root(t or "")] = min(i, ids.get(root(t or ""), i))
    return sorted((str(i), str(ids.get(root(t or "")))) for i, t, *_ in rows)


def edited(rng, base, n):
    out = list(base)
    for p in rng.choice(len(out), n, replace=False):
        out[p] = f"e{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [near_duplicates.BLOCK_ROWS, 7])
def test_classes_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "one two"), (5, "One, two"), (None, "lonely null id"), (6, LONG[:60_000]), (7, LONG[:60_000] + " end"), (8, "x"), (8, "x")]
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(150)]
        rows += [(100 * (g + 1) + n, edited(rng, base, int(rng.integers(0, 6)))) for n in range(18)]
        rows += [(100 * (g + 1) + 50 + n, " ".join(base)) for n in range(3)]
    for g in (5, 6):  # some texts of a family repeat five or more words
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [(100 * g + n, edited(rng, base, n % 3) + (" " + " ".join(base[4 : 10 + n]) if n % 2 else "")) for n in range(6)]
    shared = [f"s{i}" for i in range(40)]
    rows += [(900 + n, " ".join(shared) + " " + " ".join(f"o{n}x{i}" for i in range(30))) for n in range(20)]
    df = docs(rows)
    got = near_duplicates.near_duplicate_classes(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)
    kept = near_duplicates.drop_near_duplicates(df)
    want = {c for _, c in brute_classes(rows)}
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)
    assert near_duplicates.near_duplicate_classes(docs([])).count() == 0


def _shapes(texts):
    return [words.word_hashes(t) for t in texts]


def _sketches(text):
    return set(near_duplicates.sketches(near_duplicates.kmers(words.word_hashes(text))).tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.data())
def test_similarity_equals_the_whole_alignment(x, y, data):
    if data.draw(st.booleans()):  # else few pairs are near
        y = list(x)
        for _ in range(data.draw(st.integers(0, 4))):
            at = data.draw(st.integers(0, len(y)))
            y[at : at + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.sampled_from("abcde"), max_size=1))
    x, y = " ".join(x), " ".join(y)
    one, two = _shapes([x, y])
    assert len(set(near_duplicates.kmers(one).tolist()) & set(near_duplicates.kmers(two).tolist())) == len(set(plain_kmers(x)) & set(plain_kmers(y)))
    want, got = plain_similarity(x, y), near_duplicates.similarity(one, two)
    assert got == want if want >= 0.8 else got <= want


def test_a_text_that_repeats_words_meets_one_that_does_not():
    plain = " ".join(f"w{i}" for i in range(200))
    again = plain + " " + " ".join(f"w{i}" for i in range(5))
    assert near_duplicates.similarity(*_shapes([plain, again])) == plain_similarity(plain, again) > 0.97
    assert len(_sketches(plain) & _sketches(again)) > 30


@pytest.mark.parametrize("rate,least", [(0.01, 1.0), (0.02, 1.0), (0.04, 0.99), (0.06, 0.95), (0.08, 0.9)])
def test_recall_by_rate_of_changed_words(docs, rate, least):
    """Pairs of texts, one with changed, dropped and new words; those that are links by the whole alignment have to be in one class."""
    rng, rows, near = np.random.default_rng(int(rate * 1000)), [], []
    for n in range(200):
        base = [f"p{n}w{i}" for i in range(int(rng.integers(40, 400)))]
        other = []
        for w in base:
            kind = rng.random() / rate
            other += [w] if kind > 1 else [[f"c{rng.integers(1 << 40)}"], [], [w, f"n{rng.integers(1 << 40)}"]][int(kind * 3) % 3]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
        near += [2 * n] if plain_similarity(rows[-2][1], rows[-1][1]) >= 0.8 else []
    classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(docs(rows)).collect()}
    assert len(near) > 150 and sum(classes[i + 1] == i for i in near) >= least * len(near)
    assert all(c // 2 == i // 2 for i, c in classes.items())


def test_near_copies_of_the_test_documents_are_found(docs):
    texts = sorted({t for (t,) in connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()})
    links = brute_links(texts)
    classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(docs(list(enumerate(texts)))).collect()}
    found = sum(classes[i] == classes[j] for i, j in links)
    assert len(links) > 50 and found >= 0.95 * len(links)


@pytest.mark.parametrize("block", [near_duplicates.BLOCK_ROWS, 16])
def test_no_link_is_lost_in_families(docs, monkeypatch, block):
    """Families whose texts drift apart, of several lengths; some small blocks, so that further star rounds and components of their own blocks are met."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", block)
    rng = np.random.default_rng(17)
    texts = []
    for g, (size, n, most) in enumerate([(40, 60, 4), (120, 120, 9), (400, 50, 30), (9, 30, 2)]):
        base = [f"f{g}w{i}" for i in range(size)]
        texts += [edited(rng, base, int(rng.integers(0, most))) for _ in range(n)]
        texts += [edited(rng, base[: int(size * share)], 1) for share in (0.95, 0.85, 0.75, 0.6, 0.5)]
    texts = sorted(set(texts))
    got = near_duplicates.near_duplicate_classes(docs(list(enumerate(texts)))).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(list(enumerate(texts)))


def test_short_texts_that_lack_one_word_are_candidates():
    for i in range(400):
        long = [f"t{i}w{n}" for n in range(9)]
        x, y, z = (_sketches(t) for t in (" ".join(long), " ".join(long[:8]), " ".join(long[1:])))
        for other in (y, z):
            assert len(x & other) >= near_duplicates.AGREE


@pytest.mark.parametrize("length,edits", [(60, 1), (300, 6)])
def test_links_along_a_drifting_chain_stay_in_one_cluster(length, edits):
    """Each text differs a little from the one before; the smallest text of a sketch is another for nearly each sketch."""
    rng = np.random.default_rng(8)
    text, texts = [f"w{i}" for i in range(length)], []
    for n in range(250):
        texts.append(" ".join(text))
        for at in rng.integers(0, length, edits):
            text[at] = f"n{n}x{at}"
    shapes = _shapes(texts)
    sketched = [_sketches(t) for t in texts]
    keys = [hashlib.sha256(t.encode()).digest() for t in texts]
    least = {}
    for i, own in enumerate(sketched):
        for sketch in own:
            least[sketch] = min(least.get(sketch, i), i, key=lambda q: keys[q])
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, own in enumerate(sketched):
        met = [least[sketch] for sketch in own]
        for low in set(met):
            if met.count(low) >= near_duplicates.AGREE:
                parent[root(i)] = root(low)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, min(i + 6, len(texts)))]
    shapes = [(h, near_duplicates.kmers(h)) for h in shapes]
    linked = [(i, j) for i, j in pairs if near_duplicates.linked(shapes[i], shapes[j])]
    assert len(linked) >= 200 and all(root(i) == root(j) for i, j in linked)


def _mixed_sections(n, copies, sections=14, variants=3, size=30):
    """n texts of shared sections, and copies of the first ones with one section replaced."""
    pick = np.random.default_rng(5)
    pool = [[" ".join(f"s{i}v{v}w{w}" for w in range(size)) for v in range(variants)] for i in range(sections)]
    own = [[pool[i][v] for i, v in enumerate(pick.integers(0, variants, sections))] for _ in range(n)]
    for c in range(copies):
        at = int(pick.integers(0, sections))
        own.append([*own[c][:at], " ".join(f"new{c}w{w}" for w in range(size)), *own[c][at + 1 :]])
    return [" ".join(x) for x in own]


def test_texts_of_shared_sections_meet_though_no_smallest_text_catches_them_twice(docs):
    n, copies = 3000, 150
    texts = _mixed_sections(n, copies)
    near = [(c, n + c) for c in range(copies) if plain_similarity(texts[c], texts[n + c]) >= 0.8]
    agreeing = [(a, b) for a, b in near if len(_sketches(texts[a]) & _sketches(texts[b])) >= near_duplicates.AGREE]
    assert len(agreeing) > 100
    classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(docs(list(enumerate(texts)))).collect()}
    assert [p for p in agreeing if classes[p[0]] != classes[p[1]]] == []


@pytest.mark.parametrize("most", [near_duplicates.__dict__.get("MET_ROWS", 0), 16])
def test_twos_of_sketches_are_looked_up_without_a_row_each(spark, monkeypatch, most):
    monkeypatch.setattr(near_duplicates, "MET_ROWS", most, raising=False)
    made, write, rng = [], near_duplicates.materialise, random.Random(7)

    def told(df, label):
        made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(near_duplicates, "materialise", told)
    # sketch 0 is in all texts, a second one in some
    held = {bytes([i % 250, i // 250]): {0, *(rng.randrange(1, 4000) for _ in range(12))} for i in range(400)}
    clusters = {k: rng.choice(list(held)) for k in list(held)[:100]}
    of = lambda k: clusters.get(k, k)
    frames = spark.createDataFrame([(k, x) for k, s in held.items() for x in s], "key binary, sketch long"), spark.createDataFrame(list(clusters.items()), "node binary, component binary")
    got = near_duplicates._met_twice(*frames).collect()
    want = {(of(k), of(m)) for k, s in held.items() for m, other in held.items() if of(k) != of(m) and len(s & other) >= near_duplicates.AGREE}

    def joined(edges):
        root = {of(k): of(k) for k in held}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert want and joined(want) == joined([(bytes(r.a), bytes(r.b)) for r in got]) and {(bytes(r.a), bytes(r.b)) for r in got} <= want
    assert not any("flatten" in plan for plan in made)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 20])
def test_a_text_without_its_first_words_is_as_near_as_the_whole_chain_says(k):
    text = [f"k{k}w{i}" for i in range(5 * k)]
    x, y, z = _shapes([" ".join(text), " ".join(text[k:]), " ".join(text[:-k])])
    assert near_duplicates.chain(x, y) == whole_chain(x.tolist(), y.tolist()) == near_duplicates.chain(x, z) == 4 * k and near_duplicates.similarity(x, y) == 0.8
    got = near_duplicates.block_links([(b"a", b"a", (x, near_duplicates.kmers(x)))], [(b"b", b"b", (y, near_duplicates.kmers(y)))])
    assert got == ([(b"a", b"b")] if k > 1 else [])  # five words and four have no run of five in common


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, "t").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ARCS", 3)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 150, (60, 2))] + [(77, 200 + i) for i in range(40)] + [(500, 300 + i) for i in range(40)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {x: root(x) for p in pairs for x in p if any(x in q and q[0] != q[1] for q in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_broadcasts_are_measured(spark):
    df = spark.range(1000).selectExpr("id", "repeat('x', 1000) AS s")
    assert common.broadcast_bytes(df) > 1000 * 2000 and common.broadcast_bytes(df.limit(0)) == 0


# classifiers


def test_classifiers_have_a_score_for_everything(spark, docs):
    texts = [(i, ("you utter nitwit " if i % 2 else "kind words here ") + f"w{i} " * 5) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, _ in texts] + [(7, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int").selectExpr("*", "1 AS text")
    rows = [*texts, (200, None), (201, ""), (202, LONG), (203, " "), (0, "again")]
    for f in (toxicity.score_toxicity, quality.score_quality):
        got = f(docs(rows), labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert f(docs(rows), labels.limit(0)).count() == len(rows) and f(docs([]), labels).count() == 0
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in toxicity.score_toxicity(docs(texts), labels).collect())
    assert toxicity.drop_toxic(docs(texts), labels).columns == docs(texts).columns


def plain_char_ngrams(text):
    clean = " ".join(["", *re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()), ""])
    return {clean[i : i + n] for n in (4, 6, 8) for i in range(len(clean) - n + 1)}


def plain_toxicity(examples):
    """Dense features by n-gram, and the same steps written plainly: a function from text to score."""
    y = np.array([label for _, label in examples], float)
    sets = [plain_char_ngrams(t) for t, _ in examples]
    ratio = {}
    for gram in set().union(*sets):
        one, zero = (sum(gram in s for s, label in zip(sets, y, strict=True) if label == k) for k in (1, 0))
        r = np.log((one + 0.5) / (y.sum() + 1)) - np.log((zero + 0.5) / (len(y) - y.sum() + 1))
        if one >= 5 and r >= 1.5:
            ratio[gram] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in s) for g in names] + [1.0] for s in sets])
    w = np.array([0.0] * len(names) + [np.log(y.sum() / (len(y) - y.sum()))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 201):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
        g[:-1] += 0.01 * w[:-1] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return lambda t: 1 / (1 + np.exp(-(w[-1] + sum(w[i] * ratio[g] for i, g in enumerate(names) if g in plain_char_ngrams(t)))))


def plain_shapes(text):
    """Counts of the n-grams of a text by name, and its tokens."""
    tokens = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\x20\x09-\x0D]+", text)
    low = [t.lower() if t.isascii() else t for t in tokens]
    shapes = []
    for i, t in enumerate(tokens):
        upper, lower = (len(re.findall(c, t)) for c in ("[A-Z]", "[a-z]"))
        if not re.match(r"[A-Za-z0-9\x80-\U0010ffff]", t):
            kind = t
        else:
            kind = "digits" if re.search("[0-9]", t) else "capitals" if upper > 1 and not lower else "title" if re.match("[A-Z]", t) else "word"
        shapes.append((kind, i > 0 and low[i] == low[i - 1]))
    names = [tuple(shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)]
    names += [tuple(low[i : i + n]) for n in (1, 2) for i in range(len(low) - n + 1)]
    return {n: names.count(n) for n in set(names)}, max(1, len(tokens))


def plain_quality(examples):
    """The same updates, a weight at a time: a function from text to score."""
    z, n = {}, {}

    def weight(f):
        a, b = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - np.sign(a) * 0.02) / ((1 + b**0.5) / 2 + 0.01)

    def score(text):
        counts, tokens = plain_shapes(text)
        return 1 / (1 + np.exp(-(weight("bias") + sum(weight(f) * c / tokens for f, c in counts.items()))))

    order = np.random.default_rng(7)
    for _ in range(6):
        for i in order.permutation(len(examples)):
            text, label = examples[i]
            counts, tokens = plain_shapes(text)
            error = score(text) - label
            old = {f: weight(f) for f in ("bias", *counts)}
            for f, w in old.items():
                g = error * (1.0 if f == "bias" else counts[f] / tokens)
                b = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (((b + g * g) ** 0.5 - b**0.5) / 2) * w
                n[f] = b + g * g
    return score


@pytest.mark.parametrize("fit,plain,words_of", [(toxicity.fit, plain_toxicity, ("nitwit", "fool", "kind", "the", "sun")), (quality.fit, plain_quality, ("The", "plain", "WIN", "$$$$$", "a1", "plain"))])
def test_classifiers_equal_plain_ones(fit, plain, words_of):
    rng = np.random.default_rng(3)
    examples = []
    for i in range(60):
        label = int(rng.random() < 0.4)
        bad = words_of[:2] if fit is toxicity.fit else words_of[2:4]
        picked = list(rng.choice(words_of, 6)) + ([bad[i % 2]] if label else [])
        examples.append((" ".join(w for w in picked if label or w not in bad or rng.random() < 0.1), label))
    model, score = fit(examples), plain(examples)
    texts = [t for t, _ in examples] + ["", "nothing of it", "the NITWIT-fool, the kind", "WIN $$$$$ WIN WIN a1", "\u00c9t\u00e9 The"]
    got, want = [model.score(t) for t in texts], [score(t) for t in texts]
    assert max(want) - min(want) > 0.5 and np.allclose(got, want, atol=2e-4)


def test_samples_are_bounded_by_rows_and_bytes(spark, docs):
    rows = [(i, f"text {i} " * 10) for i in range(50)] + [(7, "a smaller one")] * 40 + [(None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2 + [(7, 0), (99, 1), (None, 1)], "doc_id long, y int")
    every = training.labelled_sample(docs(rows), labels, "y", F.lit(True), 1000)
    assert len(every) == 51 and sorted(y for t, y in every if t == "a smaller one") == [0, 1]
    few = training.labelled_sample(docs(rows), labels, "y", F.lit(True), 1000, 1000)
    assert 0 < len(few) < 15 and sum(len(t) for t, _ in few) <= 1000 and set(few) <= set(every)
    assert len(training.labelled_sample(docs(rows), labels, "y", F.lit(True), 1000, 1)) == 1
    assert training.labelled_sample(docs([]), labels, "y", F.lit(True), 10) == []


# licences


def test_license_texts_in_other_spellings(docs):
    name, text = TEXTS[0]
    changed = text.upper().replace("COPYRIGHT (C) <YEAR> <HOLDER>", "© 1999 Me\nAll rights reserved.").replace("SUBLICENSE", "sub-license").replace("\n", "\r\n ").replace("MIT LICENSE", "MIT Licence")
    rows = [(1, text), (2, changed), (3, text + " and more"), (4, None), (5, ""), (6, "x\nreleased under the MIT licence\nSPDX-License-Identifier: Apache-2.0"), (6, LONG)]
    got = licenses.scan_licenses(docs(rows)).collect()
    assert [(r.doc_id, r.license, r.notices) for r in sorted(got, key=lambda r: (r.doc_id, -r.n_notices))] == [(1, name, ""), (2, name, ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "Apache-2.0,MIT"), (6, None, "")]
    assert licenses.scan_licenses(docs([])).count() == 0


def test_whole_long_licenses_and_further_texts(spark, docs):
    folder = Path("/usr/share/common-licenses")
    known = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not folder.is_dir():
        pytest.skip("no standard texts here")
    texts = {name: (folder / file).read_text() for file, name in known.items()}
    apache = texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Me").partition("   APPENDIX")[0]
    rows = [*enumerate(texts.values()), (90, apache), (91, "Our own terms."), (92, "OUR  OWN TERMS")]
    more = spark.createDataFrame([("Own", "our own terms"), ("Other", texts["GPL-2.0"])], "license string, text string")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs(rows)).collect()} == dict(enumerate(texts)) | {90: "Apache-2.0", 91: None, 92: None}
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs(rows), more).collect()} == dict(enumerate(texts)) | {90: "Apache-2.0", 91: "Own", 92: "Own"}


#: The contract's rules, written without the operator's: equal spellings of a word, and what a line that claims copyright starts with.
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations", "recognise": "recognize", "recognised": "recognized", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "favour": "favor", "favours": "favors", "favourable": "favorable", "whilst": "while", "https": "http"}


def plain_canonical(text):
    """Case, punctuation, copyright lines and spellings made equal, word by word."""
    lines = []
    for line in re.sub("[A-Z]+", lambda m: m[0].lower(), text).split("\n"):
        start = line.lstrip(" \t\r*#/;-")
        word = start.removeprefix("copyright").lstrip(" \t:") if start.startswith("copyright") else None
        claims = start.startswith(("©", "all rights reserved")) or start.startswith("(c)") and start[3:].lstrip(" \t")[:1] in tuple("0123456789<[{")
        claims = claims or word is not None and (word.startswith(("(c)", "©")) or word[:1] in tuple("0123456789<[{"))
        lines.append("" if claims else line)
    text = "\n".join(lines).replace("sub-licen", "sublicen").replace("non-infringement", "noninfringement").replace("non-commercial", "noncommercial")
    out = [SAME.get(w, w) for w in WORD.findall(text)]
    joined = " ".join(out)
    return re.sub(r"(?<![^ ])copyright owner", "copyright holder", joined) if "copyright owner" in joined else joined


def _mistreated(text):
    """The same licence as others print it."""
    yield text
    yield text.upper()
    yield text.replace("\n", "\r\n  ").replace(",", " ,").replace('"', "''")
    yield "Copyright (c) 2019 Some One\n(c) 2020 Another\nAll rights reserved.\n" + text
    yield "/*\n * " + text.replace("\n", "\n * ") + "\n */"
    yield re.sub(r"\b(sub)?([Ll])icens", r"\1\2icenc", text).replace("noninfringement", "non-infringement").replace("http:", "https:")


def test_planted_licenses_are_found_and_digests_equal_plain_rules(spark, docs):
    planted = [(name, t) for name, text in TEXTS for t in _mistreated(text)]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs([(i, t) for i, (_, t) in enumerate(planted)])).collect()}
    first = {}
    for name, text in TEXTS:
        first.setdefault(plain_canonical(text), name)
    told = [(i, first.get(plain_canonical(t)), got[i].license) for i, (_, t) in enumerate(planted)]
    assert [x for x in told if x[1] != x[2]] == [] and sum(x[2] is not None for x in told) == len(told)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(-1, "É ÀB Copyright"), (-2, "É àB copyright."), (-3, "é àb copyright"), (-4, "ΑΣ"), (-5, "ΑΣ "), (-6, "Ⅷ"), (-7, None)]
    digests = {r.doc_id: r.digest for r in licenses.scan_licenses(docs(rows)).collect()}
    assert all(digests[i] == hashlib.sha256(plain_canonical(t or "").encode()).hexdigest() for i, t in rows)
