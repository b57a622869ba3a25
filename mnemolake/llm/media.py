"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic string of a blob in one pass. Each hit is only a claim: a validator
of its format walks the structure from there and returns the length that the structure proves, or nothing. What
starts at byte 0 corrects the declared type; what starts later is carved.

Defined results: a null blob is an empty blob; an empty blob, or one that no validator accepts, keeps its declared
type and has nothing carved; equal blobs give equal results; hits inside an accepted range aren't reported again.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import arrow_map, whole_text

#: Bytes of a row of the square 8-bit block that a payload is padded to.
BLOCK = 576
_RATE = 8000


def _png(b: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind = b[p + 4 : p + 8]
        if not kind.isalpha() or p + 12 + n > len(b) or (p == at + 8) != (kind == b"IHDR"):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags, p = b[at + 10], at + 13
    p += 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p += 10 + (3 * (2 << (local & 7)) if local & 0x80 else 0) + 1
        elif b[p] == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, scanned = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if mark < 0xC0 or n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if mark == 0xDA:
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, _, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    need = pixels + (width * bits + 31) // 32 * 4 * abs(height)
    return size if pixels >= 14 + header and need <= size <= len(b) - at else None


def _riff(kind: bytes, first: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if at + 20 > len(b) or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        p, seen = at + 12, set()
        while p + 8 <= end <= len(b):
            name, n = b[p : p + 4], int.from_bytes(b[p + 4 : p + 8], "little")
            seen.add(name)
            p += 8 + n + (n & 1)
        # the pad byte of a last odd chunk may be missing
        return end - at if end <= len(b) and p in (end, end + 1) and any(x.startswith(first) for x in seen) else None

    return check


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    try:
        data = memoryview(b)[at:]
        while data and not unpack.eof:
            unpack.decompress(data, 1 << 16)
            data = unpack.unconsumed_tail
    except zlib.error:
        return None
    return len(b) - at - len(unpack.unused_data) if unpack.eof else None


@functools.lru_cache(maxsize=4)
def _marks(b: bytes, mark: bytes) -> list[int]:
    """Where a mark stands in a blob, in order; looked for once, whatever the number of starts that ask."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


@functools.lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """The first consistent end of each start: an end record tells where its archive starts."""
    found: dict[int, int] = {}
    for end in _marks(b, b"PK\x05\x06"):
        if end + 22 > len(b):
            break
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - start - size
        if 0 <= at <= end and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            found.setdefault(at, end + 22 + note)
    return found


def _zip(b: bytes, at: int) -> int | None:
    end = _zip_ends(b).get(at)
    return None if end is None else end - at


def _after(b: bytes, mark: bytes, at: int) -> int:
    """The first place of a mark from `at` on, or -1."""
    places = _marks(b, mark)
    i = bisect.bisect_left(places, at)
    return places[i] if i < len(places) else -1


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    table, end = _after(b, b"startxref", at), _after(b, b"%%EOF", at)
    return end + 5 - at if 0 <= table < end else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks prove the start; frames have no length, so the stream reaches the end of the blob."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        last, kind, n = b[p] >> 7, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind, n) != (0, 34) or kind == 127 or p + 4 + n > len(b):
            return None
        p, first = p + 4 + n, False
        if last:
            return len(b) - at if b[p : p + 1] == b"\xff" else None
    return None


def _ogg(b: bytes, at: int) -> int | None:
    p, serial = at, b[at + 14 : at + 18]
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0 and b[p + 14 : p + 18] == serial:
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return None
        last, p = b[p + 5] & 4, p + size
        if last:
            return p - at
    return None


def _mp4(b: bytes, at: int) -> int | None:
    p, start = at - 4, at - 4
    if p < 0:
        return None
    while p + 8 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if n < 8 or p + n > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"sidx", b"meta"):
            break
        p += n
    return p - start if p > start + 8 else None


#: Media type, magic bytes, where the file starts before the magic, validator.
SIGNATURES = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP", b"VP8")),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE", b"data")),
    ("video/avi", b"RIFF", 0, _riff(b"AVI ", b"LIST")),
    ("application/gzip", b"\x1f\x8b", 0, _gzip),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("audio/flac", b"fLaC", 0, _flac),
    ("application/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", -4, _mp4),
)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in {s[1] for s in SIGNATURES}:
        out.add_word(magic.decode("latin-1"), (len(magic), [s for s in SIGNATURES if s[1] == magic]))
    out.make_automaton()
    return out


_AUTOMATON = None


def sniff(blob: bytes) -> tuple[list[tuple[str, int, int]], int]:
    """([(type, offset, length)] of what validators accept, by offset and outermost only; number of rejected claims)."""
    global _AUTOMATON
    _AUTOMATON = _AUTOMATON or _automaton()
    found, rejected, covered = [], 0, 0
    hits = [(end + 1 - n, claims) for end, (n, claims) in _AUTOMATON.iter(blob.decode("latin-1"))]
    for at, claims in sorted(hits, key=lambda x: x[0]):
        if at < covered:
            continue
        for kind, _, back, valid in claims:
            if n := valid(blob, at):
                found.append((kind, at + back, n))
                covered = at + back + n
                break
        else:
            rejected += 1
    return found, rejected


def wav_samples(blob: bytes, at: int) -> bytes:
    """The sample bytes of the 8-bit WAV that starts at a byte."""
    p = at + 12
    while blob[p : p + 4] != b"data":
        n = int.from_bytes(blob[p + 4 : p + 8], "little")
        p += 8 + n + (n & 1)
    return blob[p + 8 : p + 8 + int.from_bytes(blob[p + 4 : p + 8], "little")]


def to_wav(samples: bytes) -> bytes:
    """Mono 8-bit PCM; the payload's length is even, so no pad byte is needed."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, _RATE, _RATE, 1, 8, b"data", len(samples)) + samples


def pad(payload: bytes) -> bytes:
    return payload.ljust(max(1, -(-len(payload) // BLOCK)) * BLOCK, b"\xff")


_RANGE = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_SNIFFED = pa.struct([("detected", pa.string()), ("corrected", pa.bool_()), ("rejected", pa.int64()), ("carved", pa.list_(_RANGE))])


@arrow_map(_SNIFFED)
def _sniffed(row: dict) -> dict:
    found, rejected = sniff(row["blob"] or b"")
    kind = next((k for k, at, _ in found if at == 0), row["declared"])
    return {"detected": kind, "corrected": kind != row["declared"], "rejected": rejected, "carved": [{"type": k, "offset": at, "length": n} for k, at, n in found if at]}


def sniff_media(blob: Column, declared: Column) -> Column:
    """struct(detected, corrected, rejected, carved) for a binary column and its declared media type."""
    return _sniffed(F.struct(blob.cast("binary").alias("blob"), declared.cast("string").alias("declared")))


@arrow_map(pa.binary())
def _wav(text: str | None) -> bytes:
    return to_wav(pad((text or "").encode()))


def text_as_wav(text: Column) -> Column:
    """The text's UTF-8 bytes, padded with bytes 255 to whole blocks, as an 8-bit WAV."""
    return _wav(text.cast("string"))


_FEATURES = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


@arrow_map(_FEATURES)
def _round_trip(text: str | None) -> dict:
    data = (text or "").encode()
    blob = to_wav(pad(data))
    found, rejected = sniff(blob)
    kind, at, n = found[0]
    back = wav_samples(blob[at : at + n], 0)
    samples = np.frombuffer(back, np.uint8)
    said = f"{kind}@{at}+{n};others={len(found) - 1};rejected={rejected};mean={int(samples.sum(dtype=np.int64)) / len(samples):.4f};peak={int(samples.max())};crossings={int(np.count_nonzero(np.diff((samples > 127).view(np.int8))))}"
    return {"n_bytes": len(data), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest(), "feature": said}


def media_features(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: its text stored as a WAV, found again by sniffing, carved and described.

    Null and empty texts store one block of bytes 255. Equal texts give equal rows but for doc_id.
    """
    return documents.select("doc_id", _round_trip(whole_text()).alias("m")).select("doc_id", "m.*")
