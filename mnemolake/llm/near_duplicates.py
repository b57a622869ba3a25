"""Near duplicates by order MinHash.

Texts are sequences of words; their k-mers are five consecutive words, labelled by occurrence. A sketch is the hash of
the PICKS labelled k-mers that are smallest under one hash function, in text order, so that equal sketches speak for a
small edit distance. SKETCHES functions give as many chances; two texts are candidates where AGREE sketches are equal.

Candidates are verified by an alignment of their words: with x and y words, of which m are equal in the order of both, the
similarity is m / (x + y - m), found inside the band that the threshold allows. Its complement is a metric, an edit
distance of insertions and deletions. A link is a similarity of 0.8 or more (texts of equal length: eight words of nine) of
texts that have at least COMMON of their k-mers in common; without a common run of five words nothing is a link.
A text of fewer than five words has one k-mer, its whole sequence, so it is linked to equal ones alone.

How the work is dealt out:
1. exact copies fall to one row for each text, by digest, combined before the shuffle;
2. a star round: each text is aligned with one text only, the one that leads most of its sketches. A family of near
   copies falls together so, each text shipped once, a hot leader in parts of bounded rows and bytes;
3. sketches whose texts are all in one component are closed. What is left are texts with AGREE open sketches; pairs
   (leader, other) link them up to clusters, and sketches held by several clusters are looked up once more in twos, so
   that any two texts that agree twice are in one cluster. While a cluster is larger than some blocks and the last round
   linked a good part, another star round with other leaders goes first;
4. the texts of a cluster are cut into blocks by length, and pairs of blocks that a link can join are tasks: not those
   whose lengths are too far apart, nor those inside one component. A task counts common k-mers of all its pairs at
   once, aligns those that have enough and aren't linked yet, and gives back the links of a spanning forest;
5. components of the links are the classes.
No candidate pair is left out: what the star rounds don't settle the blocks do. What travels are hashes of words, made
once; a task makes their k-mers anew.

Defined results: a null text is the empty text; texts without words are alike only if equal; rows are copies if their
texts are equal, whatever their ids; a class is named by its smallest doc_id (null only if all are); an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm import words
from mnemolake.llm.common import arrow_map, broadcast_if_small, discard, free_name, materialise, whole_text
from mnemolake.llm.components import components

K, SIMILARITY, COMMON = 5, 0.8, 0.25
SKETCHES, PICKS, AGREE = 40, 3, 2
#: A block of a cluster holds about so many texts or words; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_WORDS = 768, 1 << 20
#: Another star round goes first where a cluster is larger than so many blocks and the last round linked at least this share of its texts.
STAR_BLOCKS, GOOD_ROUND = 8, 0.25
#: Texts of an open sketch that a task looks through at once.
MET_ROWS = 1 << 13
_CHUNK = 1 << 13
_LARGEST = np.uint64((1 << 64) - 1)
_SEEDS = words.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]
_ODD = (words.mix(_SEEDS) | np.uint64(1)).astype(np.uint64)


def labelled(s: np.ndarray) -> np.ndarray:
    """k-mers with the number of the occurrence mixed in, so that repeats differ; a first occurrence is the same in every text."""
    if not len(s):
        return s
    order = np.argsort(s, kind="stable")
    r = s[order]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    place = np.arange(len(r))
    nth = np.empty(len(r), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return words.mix(s + nth * np.uint64(0x9E3779B97F4A7C15))


def kmers(h: np.ndarray) -> np.ndarray:
    """The labelled k-mers of a sequence of hashed words, in order."""
    return labelled(words.shingles(h, K))


def sketches(s: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of PICKS labelled k-mers in text order; none of an empty text.

    Of few k-mers one changed word takes so many that the picks rarely agree: such texts get as many sketches of one k-mer
    besides. Both texts of a link are as short then, or nearly.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    short = len(s) <= 4 * PICKS
    return np.concatenate([_sketches_of(s, picks) for picks in ((PICKS, 1) if short else (PICKS,))])


def _sketches_of(s: np.ndarray, picks: int) -> np.ndarray:
    """Works through long texts in pieces."""
    best_v = np.zeros((SKETCHES, 0), np.uint64)
    best_p = np.zeros((SKETCHES, 0), np.int64)
    for begin in range(0, len(s), _CHUNK):
        v = (s[None, begin : begin + _CHUNK] ^ _SEEDS) * _ODD
        v ^= v >> np.uint64(29)
        for _ in range(min(picks, v.shape[1])):
            p = v.argmin(axis=1)[:, None]
            best_v, best_p = np.concatenate([best_v, np.take_along_axis(v, p, 1)], 1), np.concatenate([best_p, p + begin], 1)
            np.put_along_axis(v, p, _LARGEST, 1)
        if best_v.shape[1] > picks:
            keep = np.argpartition(best_v, picks - 1, axis=1)[:, :picks]
            best_v, best_p = np.take_along_axis(best_v, keep, 1), np.take_along_axis(best_p, keep, 1)
    picked = s[np.sort(best_p, axis=1)]
    h = words.mix(_SEEDS[:, 0] + np.uint64(picks))
    for i in range(picked.shape[1]):
        h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + picked[:, i])
    return h.view(np.int64)


@arrow_map(pa.list_(pa.int64()))
def _text_sketches(text: str) -> list[int]:
    return sketches(kmers(words.word_hashes(text))).tolist()


@arrow_map(pa.binary())
def _text_words(text: str) -> bytes:
    return words.word_hashes(text).tobytes()


def chain(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> int:
    """How many words are equal in the order of both texts, inside the band that a similarity of `least` leaves.

    What both begin and end with is taken first. The rest is aligned a word of y at a time, all places of x at once: the
    bits of an integer are the steps of a row of the alignment's matrix, and a word moves them by one addition.
    """
    # a whole number may come out just below itself; a band that is a little wide loses nothing
    band = int((len(x) + len(y)) * (1 - least) / (1 + least) + 1e-6)
    if abs(len(x) - len(y)) > band:
        return 0
    short = min(len(x), len(y))
    head = _equal_run(x[:short], y[:short])
    tail = min(_equal_run(x[::-1][:short], y[::-1][:short]), short - head)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not len(x) or not len(y):
        return head + tail
    both = np.intersect1d(x, y)
    at = np.flatnonzero(np.isin(x, both))
    places: dict[int, int] = {}
    for i, w in zip(at.tolist(), x[at].tolist(), strict=True):
        places[w] = places.get(w, 0) | 1 << i
    whole, width = (1 << len(x)) - 1, (1 << 2 * band + 1) - 1
    steps = whole
    at = np.flatnonzero(np.isin(y, both))
    for j, w in zip(at.tolist(), y[at].tolist(), strict=True):
        found = places[w] & (width << j - band if j >= band else width >> band - j)
        up = steps & found
        steps = ((steps + up) | (steps - up)) & whole
    return head + tail + len(x) - steps.bit_count()


def _equal_run(x: np.ndarray, y: np.ndarray) -> int:
    """How many words two sequences of one length have in common at their beginning."""
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else len(x)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sequences of hashed words; below the threshold it may come out smaller than it is."""
    total = len(x) + len(y)
    if not total:
        return 0.0
    # no order has more equal words than there are without order
    if len(np.intersect1d(labelled(x), labelled(y), assume_unique=True)) < SIMILARITY / (1 + SIMILARITY) * total - 1e-6:
        return 0.0
    m = chain(x, y)
    return m / (total - m)


def linked(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Of two texts as (hashed words, labelled k-mers)."""
    common = len(np.intersect1d(x[1], y[1], assume_unique=True))
    return common > 0 and common >= COMMON * (len(x[1]) + len(y[1]) - common) and similarity(x[0], y[0]) >= SIMILARITY


def _common(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers each of rows has in common with each of cols."""
    out = np.zeros((len(rows), len(cols)), np.float32)
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (rows, cols)]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (rows, cols)]
    seen = np.intersect1d(flat[0], flat[1])
    if not len(seen):
        return out
    at = []
    for f, o in zip(flat, owner, strict=True):
        p = np.searchsorted(seen, f)
        p[p == len(seen)] = 0
        held = seen[p] == f
        at.append((p[held], o[held]))
    step = 2048
    sorted_at = [(p[order := np.argsort(p, kind="stable")], o[order]) for p, o in at]
    for begin in range(0, len(seen), step):
        sides = []
        for (p, o), side in zip(sorted_at, (rows, cols), strict=True):
            a, b = np.searchsorted(p, (begin, begin + step))
            m = np.zeros((len(side), min(step, len(seen) - begin)), np.float32)
            m[o[a:b], p[a:b] - begin] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _reaches(common: np.ndarray, least: float, rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Whether what each of rows has in common with each of cols can be a share of `least`, with room for rounding."""
    total = np.add.outer([len(x) for x in rows], [len(x) for x in cols])
    return common >= least / (1 + least) * total - 0.01


def block_links(left: list[tuple], right: list[tuple] | None) -> list[tuple[bytes, bytes]]:
    """Links of a spanning forest of the pairs between two blocks, or within one (right is None).

    A text is (key, component, (hashed words, labelled k-mers)); texts of one component need no link.
    """
    rows, cols = ([x[1] for _, _, x in side] for side in (left, left if right is None else right))
    texts = left + (right or [])
    shift = len(left) if right is not None else 0
    n, m = np.array([len(x) for x in rows], np.float32)[:, None], np.array([len(x) for x in cols], np.float32)[None, :]
    common = _common(rows, cols)
    able = (common > 0) & _reaches(common, COMMON, rows, cols)
    if right is None:
        able = np.triu(able, 1)
    # and no order has more equal words than there are without order; of most pairs that says enough
    i, j = able.any(axis=1).nonzero()[0], able.any(axis=0).nonzero()[0]
    bags = [[labelled(side[at][2][0]) for at in which] for side, which in ((left, i), (left if right is None else right, j))]
    able[np.ix_(i, j)] &= _reaches(_common(*bags), SIMILARITY, *bags)
    i, j = np.nonzero(able)
    leads: dict[bytes, int] = {}
    parent = [leads.setdefault(of, at) for at, (_, of, _) in enumerate(texts)]

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    links = []
    # the most alike first: they link most, and what is linked needs no alignment
    for q in np.argsort(-(common[i, j] / (n[i, 0] + m[0, j])), kind="stable").tolist():
        a, b = int(i[q]), int(j[q]) + shift
        if root(a) != root(b) and linked(texts[a][2], texts[b][2]):
            parent[root(a)] = root(b)
            links.append((texts[a][0], texts[b][0]))
    return links


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _texts(table: pa.Table) -> list[tuple]:
    """(key, component, (hashed words, labelled k-mers), whether on the other side) of each row, by key."""
    columns = (table.column(c).to_pylist() for c in ("key", "of", "words", "side"))
    shape = lambda x: (h := np.frombuffer(x, np.uint64), kmers(h))
    return sorted(((k, of, shape(x), side) for k, of, x, side in zip(*columns, strict=True)), key=lambda x: x[0])


def _table(links: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], schema=_LINKS)


def _block_task(table: pa.Table) -> pa.Table:
    texts = _texts(table)
    left, right = ([x[:3] for x in texts if x[3] == side] for side in (False, True))
    return _table(block_links(left, None if table.column("same")[0].as_py() else right))


def _star_task(table: pa.Table) -> pa.Table:
    """Links of the leader (side is true) with the others; a part of a star always has its leader."""
    texts = _texts(table)
    lead, _, shape, _ = next(x for x in texts if x[3])
    return _table([(lead, k) for k, _, x, side in texts if not side and linked(shape, x)])


def _parts(rows: Column, n_words: Column) -> Column:
    """Into how many parts of bounded rows and words a group is cut."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(n_words / BLOCK_WORDS), F.lit(1)).cast("int")


def _led(held: DataFrame, turn: int) -> DataFrame:
    """held (key, of, sketch) with the leader of each sketch, which another turn chooses anew; where a sketch has one text, no row."""
    rank = F.struct(F.xxhash64(F.lit(turn), "key").alias("h"), "key", "of")
    least = held.groupBy("sketch").agg(F.min(rank).alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select(F.col("sketch").alias("met"), F.col("least.key").alias("low"), F.col("least.of").alias("low_of"))
    return held.join(least, F.col("sketch") == F.col("met")).select("key", "of", "sketch", "low", "low_of")


def _star_links(led: DataFrame, shapes: DataFrame) -> DataFrame:
    """Links of texts with the one leader that most of their sketches have, at least AGREE, and that isn't in their component."""
    votes = led.where(F.col("of") != F.col("low_of")).groupBy("key", "low").agg(F.count("*").alias("n")).where(F.col("n") >= AGREE)
    star = materialise(votes.groupBy("key").agg(F.max(F.struct("n", "low"))["low"].alias("low")), "star")
    sizes = star.join(shapes.select("key", "n_words"), "key").groupBy("low").agg(_parts(F.count("*"), F.sum("n_words")).alias("parts"))
    sizes = materialise(sizes, "sizes")
    # most stars are one part; the others are few, so that their texts needn't meet in a task
    large = sizes.where("parts > 1").select(F.col("low").alias("l"), "parts")
    split = F.pmod(F.xxhash64(F.lit("part"), "key"), F.coalesce("parts", F.lit(1))).cast("int")
    others = star.join(broadcast_if_small(large), F.col("low") == F.col("l"), "left").select("key", "low", split.alias("part"), F.lit(False).alias("side"))
    leads = sizes.select(F.col("low").alias("key"), "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("side"))
    dealt = others.unionByName(leads).join(shapes.select("key", "words"), "key").withColumn("of", F.col("key"))
    found = materialise(dealt.groupBy("low", "part").applyInArrow(_star_task, "a binary, b binary"), "links")
    discard(star, sizes)
    return found


def _met_apart(shared: DataFrame, named: DataFrame) -> DataFrame:
    """(key, of, s) of the texts that have AGREE sketches whose texts are in several components; s has those sketches."""
    held = shared.join(named, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("of"), "sketch")
    is_open = held.groupBy("sketch").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low != high").select(F.col("sketch").alias("open"))
    texts = held.join(is_open, F.col("sketch") == F.col("open")).groupBy("key").agg(F.first("of").alias("of"), F.collect_set("sketch").alias("s"))
    return texts.where(F.size("s") >= AGREE)


def _open(shared: DataFrame, named: DataFrame) -> DataFrame:
    """_met_apart with a row for each sketch: (key, of, sketch)."""
    return _met_apart(shared, named).select("key", "of", F.explode("s").alias("sketch"))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sketch, part, of, rest), in order of sketch and part, to edges (a, b): who has a sketch of rest with another meets the first that has both."""
    at, first = None, {}
    for batch in batches:
        edges = set()
        for sketch, part, of, rest in zip(*(batch.column(c).to_pylist() for c in ("sketch", "part", "of", "rest")), strict=True):
            if at != (sketch, part):
                at, first = (sketch, part), {}
            edges.update((low, of) for y in rest if (low := first.setdefault(y, of)) != of)
        yield _table(list(edges)).combine_chunks().to_batches()[0] if edges else pa.RecordBatch.from_pylist([], schema=_LINKS)


def _met_twice(held: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges (a, b) between clusters, or texts in none, two texts of which agree in two sketches of held (key, sketch); AGREE is 2.

    A text is a row for each of its sketches, with those that come after it, so that twos are looked up where the first of
    them lies and are never rows. A sketch of more than MET_ROWS texts is cut into parts by the second of the two.
    """
    texts = _met_apart(held.select("key", "sketch"), clusters).select("of", F.array_sort("s").alias("s")).distinct()
    each = texts.select("of", "s", F.posexplode(F.slice("s", F.lit(1), F.size("s") - 1)).alias("i", "sketch"))
    each = materialise(each.select("sketch", "of", F.slice("s", F.col("i") + 2, F.size("s")).alias("rest")), "apart")
    sizes = each.groupBy("sketch").agg(F.count("*").alias("n")).where(F.col("n") > MET_ROWS)
    hot = materialise(sizes.select(F.col("sketch").alias("met"), F.ceil(F.col("n") / MET_ROWS).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        dealt = each.withColumn("part", F.lit(0))
    else:
        of_hot = each.join(broadcast_if_small(hot), F.col("sketch") == F.col("met"), "left")
        part = lambda y: F.pmod(F.xxhash64(y), F.col("parts")).cast("int")
        cut = F.transform(F.array_distinct(F.transform("rest", part)), lambda p: F.struct(p.alias("part"), F.filter("rest", lambda y: part(y) == p).alias("rest")))
        whole = F.array(F.struct(F.lit(0).alias("part"), "rest"))
        dealt = of_hot.select("sketch", "of", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(cut)).alias("x")).select("sketch", "of", "x.part", "x.rest")
    dealt = dealt.repartition("sketch", "part").sortWithinPartitions("sketch", "part")
    found = materialise(dealt.mapInArrow(_meetings, "a binary, b binary").distinct(), "twice")
    discard(each, hot)
    return found


def _clusters(led: DataFrame) -> DataFrame:
    """(node, component): any two texts that agree twice are in one component."""
    pairs = led.where(F.col("key") != F.col("low")).groupBy("low", "key").agg(F.count("*").alias("n")).where(F.col("n") >= AGREE)
    pairs = materialise(pairs.select(F.col("low").alias("a"), F.col("key").alias("b")), "pairs")
    # a text goes with one of those that lead it for now: which it is decides how much is left, not what is found
    near = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    rest = _met_twice(led, near)
    clusters = components(pairs.unionByName(rest), "clusters")
    discard(pairs, rest)
    return clusters


def _block_links(members: DataFrame, shapes: DataFrame) -> DataFrame:
    """Links between texts of different components (of) in each cluster of members (cluster, key, of, n_words)."""
    # lengths of two linked texts are at most a factor of 1 / SIMILARITY apart, so their steps are equal or neighbours
    step = F.floor(F.log(F.col("n_words")) / F.log(F.lit(1 / SIMILARITY)) + 1e-9).cast("int")
    members = members.withColumn("step", step)
    # a component larger than a block has blocks of its own, which are never compared with each other
    own = members.groupBy("cluster", "step", F.col("of").alias("big")).agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK_ROWS).drop("rows")
    own = materialise(own.withColumnRenamed("cluster", "c").withColumnRenamed("step", "s"), "large")
    members = members.join(broadcast_if_small(own), (F.col("cluster") == F.col("c")) & (F.col("step") == F.col("s")) & (F.col("of") == F.col("big")), "left").drop("c", "s")
    members = members.withColumn("big", F.coalesce("big", F.lit(b"")))
    sizes = members.groupBy("cluster", "step", "big").agg(_parts(F.count("*"), F.sum("n_words")).alias("parts"))
    sizes = materialise(sizes, "sizes")
    large = sizes.where("parts > 1").select(F.col("cluster").alias("c"), F.col("step").alias("s"), F.col("big").alias("l"), "parts")
    placed = members.join(broadcast_if_small(large), (F.col("cluster") == F.col("c")) & (F.col("step") == F.col("s")) & (F.col("big") == F.col("l")), "left")
    part = F.pmod(F.xxhash64(F.lit("block"), "key"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = materialise(placed.select("cluster", "key", "of", F.struct("step", "big", part.alias("part")).alias("block")), "blocks")
    blocks = sizes.select("cluster", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct("step", "big", p.alias("part")))).alias("block"))
    one, two = blocks.select(F.col("cluster").alias("c"), F.col("block").alias("i")), blocks.select(F.col("cluster").alias("d"), F.col("block").alias("j"))
    apart = (F.col("j.step") - F.col("i.step") > 1) | ((F.col("i.big") == F.col("j.big")) & (F.col("i.big") != F.lit(b"")))
    tasks = materialise(one.join(two, (F.col("c") == F.col("d")) & (F.col("i") <= F.col("j"))).where(~apart).select("c", "i", "j"), "tasks")
    sides = [placed.join(tasks, (F.col("cluster") == F.col("c")) & (F.col("block") == F.col(at))).select("key", "of", "c", "i", "j", F.lit(at == "j").alias("side")) for at in "ij"]
    dealt = sides[0].unionByName(sides[1].where("i != j")).join(shapes.select("key", "words"), "key").withColumn("same", F.col("i") == F.col("j"))
    found = materialise(dealt.groupBy("c", "i", "j").applyInArrow(_block_task, "a binary, b binary"), "links")
    discard(own, sizes, placed, tasks)
    return found


def links(rows: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that span the classes of rows (key, doc_id, text), given (key, doc_id, sketches) of each text; and those classes (node, component)."""
    pieces = sketched.select("key", F.explode("sketches").alias("sketch"))
    met = pieces.groupBy("sketch").agg(F.count("*").alias("n")).where("n > 1").select(F.col("sketch").alias("met"))
    shared = pieces.join(met, F.col("sketch") == F.col("met"), "left_semi").groupBy("key").agg(F.collect_set("sketch").alias("s")).where(F.size("s") >= AGREE)
    shared = materialise(shared, "shared")
    wanted = materialise(sketched.select(F.col("key").alias("k"), F.col("doc_id").alias("of")).join(shared.select(F.col("key").alias("k")), "k"), "wanted")
    shapes = rows.join(broadcast_if_small(wanted), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("of")))
    # of rows that repeat with their id any one does
    shapes = shapes.select("key", _text_words(F.col("text")).alias("words")).groupBy("key").agg(F.first("words").alias("words"))
    shapes = materialise(shapes.withColumn("n_words", F.length("words") / 8), "shapes")
    discard(wanted)
    held = shared.select("key", F.col("key").alias("of"), F.explode("s").alias("sketch"))
    every, named, turn = [], None, 0
    while True:
        found = _star_links(_led(held, turn), shapes)
        linked, texts = found.count(), held.select("key").distinct().count()
        if every:
            discard(held)
        every.append(found)
        edges = found if named is None else found.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
        named, turn = components(edges, "named"), turn + 1
        held = materialise(_open(shared.select("key", F.explode("s").alias("sketch")), named), "open")
        if held.isEmpty():
            break
        clusters = _clusters(_led(held, turn))
        members = clusters.join(held.select("key", "of").distinct(), F.col("node") == F.col("key")).join(shapes.select("key", "n_words"), "key")
        members = materialise(members.select(F.col("component").alias("cluster"), "key", "of", "n_words"), "members")
        largest = members.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= STAR_BLOCKS * BLOCK_ROWS or linked < GOOD_ROUND * texts:
            found = _block_links(members, shapes)
            every.append(found)
            named = components(found.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))), "named")
            discard(members, held)
            break
        discard(members)
    discard(shared, shapes)
    spanning = every[0]
    for more in every[1:]:
        spanning = spanning.unionByName(more)
    return spanning, named


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", whole_text().alias("text")).withColumn("key", _key(F.col("text")))


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def text_classes(documents: DataFrame) -> DataFrame:
    """One row for each text: key, doc_id (its smallest), rows (with that doc_id), class_id, class_rows, n_links."""
    rows = _keyed(documents)
    each = rows.select("key", "doc_id", _text_sketches(F.col("text")).alias("sketches"))
    sketched = each.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sketches").alias("sketches"))
    sketched = materialise(sketched, "sketches")
    found, named = links(rows, sketched)
    labels = sketched.select("key", "doc_id", "copies").join(named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    classes = labels.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    return labels.join(classes, "component").join(degree, "key", "left").select("key", "doc_id", "component", "class_id", "class_rows", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicate_classes(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, class_id, class_rows, n_links (of its text, among links that span its class)."""
    classes = text_classes(documents).select("key", "class_id", "class_rows", "n_links")
    return _keyed(documents).select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "class_rows", "n_links")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents with one row of each class, columns unchanged: a row of the smallest doc_id.

    Of several texts of that id the first by digest stays; of equal rows with that id any one.
    """
    classes = materialise(text_classes(documents).where("class_rows > 1").select("key", "doc_id", "component", "class_id"), "classes")
    key, stays, of = (free_name(documents, name) for name in ("kept_key", "kept_text", "kept_id"))
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("component").alias("c")).agg(F.min("key").alias("k"))
    # of the texts of larger classes: whether they stay, and with which id; a class of one row needs no decision
    told = classes.join(first, F.col("component") == F.col("c")).select(F.col("key").alias(key), (F.col("key") == F.col("k")).alias(stays), F.col("doc_id").alias(of))
    told = materialise(told, "kept")
    judged = documents.join(broadcast_if_small(told), _key(whole_text()) == F.col(key), "left")
    kept = F.col(stays) & F.col("doc_id").eqNullSafe(F.col(of))
    # ids that repeat with the same text are rare, and known from ids and digests alone
    again = _keyed(documents).groupBy("key", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        found = judged.where(F.col(key).isNull() | kept)
    else:
        found = judged.where(F.col(key).isNull()).unionByName(judged.where(kept).dropDuplicates([key]))
    discard(classes)
    return found.drop(key, stays, of)
