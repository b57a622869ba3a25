"""Personal data: offset-preserving deobfuscation.

Base identifiers are matched in the text as it stands. Then three transducers rewrite a copy: homoglyphs fold to
ASCII, spelled digits become digits, and at/dot disguises become @ and dot. Each output character keeps the source
range that it came from, so that what is detected in the copy maps back to code points of the source. A span is added
where no base span of its kind holds it already.

Defined results: a null text is empty; an empty text has no spans; each row stands by itself.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from mnemolake.llm.common import arrow_map, whole_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that starts inside a run of digits can't succeed where the run's start failed, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the plain pattern finds them, but it looks left and right of each @, so that long runs without one cost nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = floor = m.end()
            yield start, end
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def find_base(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind: leftmost, non-overlapping, a failing match dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = list(_emails(text))
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


#: Characters that look like an ASCII one, beyond what compatibility folding and digit values give.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
#: Characters that show nothing.
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Words for 0 to 9, in English, German, French and Spanish.
NUMBER_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
_DIGIT = {w: str(i) for i, words in enumerate(NUMBER_WORDS) for w in words}
_NUMBER = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
#: Seven spelled digits in a row are a number; "plus" before them is its sign.
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]+)?{_NUMBER}(?:[ ,.-]{{1,3}}{_NUMBER}){{6,}}(?!\w)")
_SPELLED_PART = re.compile(rf"(?P<plus>plus)|(?P<word>{_NUMBER})|(?P<gap>[ ,.-]+)")
#: Number words, digits and dot words beside each other, in any mixture, are a candidate; the detectors' own checks decide.
_DOT_GAP = "(?: +(?:dot|punkt|point|punto) +)"
_MIXED = re.compile(rf"(?<![\w+])(?:plus[ ,-]+|\+)?(?:{_NUMBER}|[0-9]+)(?:(?:{_DOT_GAP}|[ ,.()/-]{{1,3}})(?:{_NUMBER}|[0-9]+))+(?!\w)")
_MIXED_PART = re.compile(rf"(?P<dot>{_DOT_GAP})|(?P<plus>plus[ ,-]+)|(?P<word>{_NUMBER})|(?P<digits>[0-9]+)|(?P<gap>[ ,.()/-]+)")
_DOT_SPOKEN = (" dot ", " punkt ", " point ", " punto ")
#: A run of numbers has one of these after its first.
_SPACED = tuple(c + w for w in _DIGIT for c in " ,.-")
_AT_WORDS, _DOT_WORDS = "at|@|arroba|arobase|klammeraffe", r"dot|\.|punkt|point|punto"
#: Blanks before a bracket are taken by hand: a pattern that starts with them would start anew at each of a long run.
_AT = re.compile(rf"[\[({{<][ ]*(?:{_AT_WORDS})[ ]*[\])}}>][ ]*", re.I)
_DOT = re.compile(rf"[\[({{<][ ]*(?:{_DOT_WORDS})[ ]*[\])}}>][ ]*", re.I)
#: Without brackets an address has a spelled dot besides its at; the other dots may be plain. Where another at follows, the
#: address is that one's: "me at joe dot doe at ex dot com". Spelled dots before the at are found from there to the left.
_BARE = re.compile(
    r"(?<![\w.+%-])[a-z0-9._%+-]+(?P<at> +at +| *@ *)(?>[a-z0-9-]+(?:\.[a-z0-9-]+)*(?: +dot +[a-z0-9-]+(?:\.[a-z0-9-]+)*)+)(?! +at +[a-z0-9])"
    r"|(?<![\w.+%-])[a-z0-9._%+-]+(?P<sign> +@ *| *@ +)[a-z0-9-]+(?:\.[a-z0-9-]+)+",
    re.I,
)
_BARE_PART = re.compile(r"(?P<at> +at +| *@ *)|(?P<dot> +dot +)", re.I)


def _brackets(text: str) -> list[tuple[int, int, str]]:
    """Edits for bracketed at and dot words, with the blanks around them."""
    out, reach = [], 0
    for a, b, new in sorted([(*m.span(), "@") for m in _AT.finditer(text)] + [(*m.span(), ".") for m in _DOT.finditer(text)]):
        while a > reach and text[a - 1] == " ":
            a -= 1
        if a >= reach:
            out.append((a, b, new))
            reach = b
    return out


def _run_before(text: str, at: int, floor: int, of: frozenset) -> int:
    """Where the run of characters that ends at `at` starts."""
    while at > floor and text[at - 1] in of:
        at -= 1
    return at


_BLANK = frozenset(" ")


def _dotted_before(text: str, start: int, floor: int) -> list[tuple[int, int, str]]:
    """Edits for spelled dots to the left of an address whose local part starts at start: "joe dot " before "doe at ex dot com"."""
    out = []
    while True:
        word_end = _run_before(text, start, floor, _BLANK)
        dot = word_end - 3
        blank = _run_before(text, dot, floor, _BLANK) if dot > floor and word_end < start and text[dot:word_end].lower() == "dot" else dot
        word = _run_before(text, blank, floor, _LOCAL) if floor < blank < dot else blank
        if not floor <= word < blank < dot:
            return out[::-1]
        out.append((blank, start, "."))
        start = word


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits for addresses whose at or dots are words without brackets."""
    out, floor = [], 0
    for m in _BARE.finditer(text):
        out += _dotted_before(text, m.start(), floor)
        out += [(*p.span(), "@" if p["at"] else ".") for p in _BARE_PART.finditer(text, *m.span())]
        floor = m.end()
    return out


class Tape:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) by a string, for edits in order; each new character stands for the whole range."""
        if not edits:
            return
        text, start, end, p = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[p:a], new]
            start += self.start[p:a] + [self.start[a]] * len(new)
            end += self.end[p:a] + [self.end[b - 1]] * len(new)
            p = b
        self.text, self.start, self.end = "".join([*text, self.text[p:]]), start + self.start[p:], end + self.end[p:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _fold(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    value = unicodedata.digit(c, None)
    if value is not None:
        return str(value)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and len(folded) == 1 else c


_folded: dict[str, str] = {}


def _fold_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    changed = {}
    for c in set(text):
        if not c.isascii():
            if c not in _folded:
                _folded[c] = _fold(c)
            if _folded[c] != c:
                changed[c] = _folded[c]
    return [(m.start(), m.end(), changed[m[0]]) for m in re.finditer("[" + re.escape("".join(changed)) + "]", text)] if changed else []


def deobfuscate(text: str) -> Tape | None:
    """The rewritten copy, or None where no transducer changes anything."""
    tape = Tape(text) if (edits := _fold_edits(text)) else None
    if edits:
        tape.rewrite(edits)
    now = tape.text if tape else text
    spelled, low = [], now.lower()
    if len(low) != len(now):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in now)
    for run in _SPELLED.finditer(low) if any(w in low for w in _SPACED) else ():
        spelled += [(p.start(), p.end(), "+" if p["plus"] else _DIGIT[p["word"]] if p["word"] else "") for p in _SPELLED_PART.finditer(low, *run.span())]
    if spelled:
        tape = tape or Tape(text)
        tape.rewrite(spelled)
        now = tape.text
    marks = _brackets(now) if any(c in now for c in "[({<") else []
    if marks:
        tape = tape or Tape(text)
        tape.rewrite(marks)
        now = tape.text
    if " dot " in low or spelled and " dot " in now.lower() or " @" in now or "@ " in now:
        bare = _bare(now)
        if bare:
            tape = tape or Tape(text)
            tape.rewrite(bare)
    return tape


def _mixed_tapes(low: str, a: int, b: int) -> Iterator[Tape]:
    """A run of numbers in two readings of a plain dot beside a number word: a gap like others, and a dot."""
    parts = list(_MIXED_PART.finditer(low, a, b))
    if all(p["digits"] or p["gap"] for p in parts) or not any(c.isalpha() for c in low[a:b]):
        return
    for dots in (False, True) if "." in low[a:b] else (False,):
        edits = []
        for i, p in enumerate(parts):
            new = "." if p["dot"] else "+" if p["plus"] else _DIGIT[p["word"]] if p["word"] else p[0]
            if p["gap"] and 0 < i < len(parts) - 1 and (sides := [bool(parts[i + d]["word"]) for d in (-1, 1)]) and any(sides):
                new = "." if dots and p[0] == "." else "" if all(sides) else " "
            if new != p[0]:
                edits.append((p.start() - a, p.end() - a, new))
        tape = Tape(low[a:b])
        tape.rewrite(edits)
        yield tape


def mixed_numbers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of addresses, cards and phones that mix number words, digits and dot words."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    outer = None
    if edits := _fold_edits(text):
        outer = Tape(text)
        outer.rewrite(edits)
    now = outer.text if outer else text
    low = now.lower()
    if len(low) != len(now):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in now)
    if not any(w in low for w in (*_SPACED, *_DOT_SPOKEN)):
        return out
    for run in _MIXED.finditer(low):
        for tape in _mixed_tapes(low, *run.span()):
            for kind, found in find_base(tape.text).items():
                for x in found:
                    a, b = (run.start() + y for y in tape.source(*x))
                    out[kind].append(outer.source(a, b) if outer else (a, b))
    return out


def find_all(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, base and added spans), by kind and start."""
    base = find_base(text)
    every = {k: list(v) for k, v in base.items()}
    if tape := deobfuscate(text):
        for kind, found in find_base(tape.text).items():
            # base spans of a kind don't overlap, so only the last one that starts no later can hold a span
            starts = [s for s, _ in base[kind]]
            for a, b in (tape.source(*x) for x in found):
                before = bisect_right(starts, a)
                if not before or b > base[kind][before - 1][1]:
                    every[kind].append((a, b))
            every[kind].sort()
    for kind, found in mixed_numbers(text).items():
        if found:
            own, kept, reach = set(base[kind]), [], 0
            # of added spans one inside another goes; base spans stay
            for x in sorted({*every[kind], *found}, key=lambda x: (x[0], -x[1])):
                if x in own or x[1] > reach:
                    kept.append(x)
                reach = max(reach, x[1])
            every[kind] = kept
    return base, every


def _written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def mask(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays, a longer one before a shorter."""
    out, p = [], 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda x: (x[0], -x[1])):
        if a >= p:
            out += [text[p:a], f"[{kind.upper()}]"]
            p = b
        elif b > p:
            p = b
    return "".join([*out, text[p:]])


_SHAPE = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


@arrow_map(_SHAPE)
def _scan(text: str | None) -> dict:
    base, every = find_all(text or "")
    return {f"n_{k}": len(base[k]) for k in KINDS} | {"base_sha256": hashlib.sha256(_written(base).encode()).hexdigest(), "spans": _written(every), "n_added": sum(len(every[k]) - len(base[k]) for k in KINDS)}


@arrow_map(pa.string())
def _mask(text: str | None) -> str | None:
    return None if text is None else mask(text, find_all(text)[1])


def scan_personal_data(documents: DataFrame) -> DataFrame:
    """One row for each row of documents. n_* and base_sha256 tell of base spans; spans has the added ones too."""
    return documents.select("doc_id", _scan(whole_text()).alias("p")).select("doc_id", "p.*")


def mask_personal_data(text: Column) -> Column:
    """The text with every span replaced by [EMAIL], [IP], [CARD] or [PHONE]; null stays null."""
    return _mask(text.cast("string"))
