"""Media columns: storing, signature sniffing, type correction and carving (operator 4).

An Aho-Corasick automaton locates the magic bytes of all formats in one pass. At each hit the format's validator walks
the structure and gives the medium's length, or rejects the hit. A medium's type is that of the valid hit at its start,
whatever type was declared; valid hits further in are embedded media and can be carved out.

Limits by the formats: a stored payload is below 4 GiB. Defined results: null and empty texts are stored as one block
of 192 blanks; a blob in which nothing is valid keeps its declared type and has valid = false; repeated rows each give
their row; an empty table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.batches import arrow_schema, map_texts, released

BLOCK, RATE = 192, 8000


class Found(NamedTuple):
    kind: str
    start: int
    length: int


def _png(b: bytes, at: int, known: dict) -> int | None:
    p = at + 8
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or p == at + 8 and (name != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        p += 12 + size
        if name == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int, known: dict) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    ends = known.setdefault("gif", {})  # (in a block's data, place) -> where the image ends from there on
    state, walked = (False, at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)), []
    while state not in ends:
        walked.append(state)
        inside, p = state
        if p >= len(b):
            ends[state] = None
        elif inside:
            state = (bool(b[p]), p + b[p] + 1)
        elif b[p] == 0x3B:
            ends[state] = p + 1
        elif b[p] == 0x21:
            state = (True, p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            state = (True, p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            ends[state] = None
    end = ends[state]
    ends.update(dict.fromkeys(walked, end))
    return None if end is None else end - at


def _bmp(b: bytes, at: int, known: dict) -> int | None:
    if at + 54 > len(b):
        return None
    size, r1, r2, data, header, w, h, planes, bits = struct.unpack_from("<IHHIIiiHH", b, at + 2)
    if r1 or r2 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or w <= 0 or h == 0 or data < 14 + header:
        return None
    if b[at + 30 : at + 34] == b"\0\0\0\0" and size < data + (w * bits + 31) // 32 * 4 * abs(h):
        return None
    return size if at + size <= len(b) else None


def _riff(b: bytes, at: int, known: dict) -> int | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    if form not in _RIFF_FORMS or size < 4 or at + 8 + size > len(b):
        return None
    p, end, names = at + 12, at + 8 + size, set()
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        names.add(name)
        p += 8 + n + n % 2
    return 8 + size if form != b"WAVE" or {b"fmt ", b"data"} <= names else None


def _jpeg(b: bytes, at: int, known: dict) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9 or 0xD0 <= mark <= 0xD8 or mark < 0xC0:
            return None
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xDA:
            lo, end = known.get("jpeg", (0, -2))
            if not (lo <= p <= end or lo <= p and end == -1):  # else no end stands between there and here
                known["jpeg"] = (p, end := b.find(b"\xff\xd9", p))
            return end + 2 - at if end >= 0 else None
    return None


def _pdf(b: bytes, at: int, known: dict) -> int | None:
    if b[at + 5 : at + 6] not in (b"1", b"2") or b[at + 6 : at + 7] != b".":
        return None
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.rfind(b"startxref", at, end) >= 0 else None


def _zip(b: bytes, at: int, known: dict) -> int | None:
    if "zip" not in known:  # each end record says where its archive starts
        starts: dict[int, int] = {}
        end = b.find(b"PK\x05\x06")
        while 0 <= end and end + 22 <= len(b):
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            first = end - size - start
            if end + 22 + note <= len(b) and (not size or b[end - size : end - size + 4] == b"PK\x01\x02"):
                starts.setdefault(first, end + 22 + note)
            end = b.find(b"PK\x05\x06", end + 4)
        known["zip"] = starts
    end = known["zip"].get(at)
    return None if end is None else end - at


def _gzip(b: bytes, at: int, known: dict) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else None


def _ogg(b: bytes, at: int, known: dict) -> int | None:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        table = b[p + 27 : p + 27 + b[p + 26]]
        last = b[p + 5] & 4
        p += 27 + b[p + 26] + sum(table)
        if p > len(b):
            return None
        if last:
            return p - at
    return p - at if p > at else None


#: Forms of RIFF files, magic bytes and the types that they announce.
_RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"RIFF": ("riff", _riff),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"OggS": ("audio/ogg", _ogg),
}

_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in MAGIC:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def scan(blob: bytes) -> Iterator[Found]:
    """The valid media of a blob, outermost first: within one that was found, the search goes on."""
    tried, known = 0, {}  # known: what validators found out about the blob as a whole, so that many starts don't cost many passes
    for end, magic in _automaton().iter(blob.decode("latin-1")):
        start = end + 1 - len(magic)
        kind, valid = MAGIC[magic]
        if magic == b"OggS" and start < tried:
            continue  # a later page of the same stream
        length = valid(blob, start, known)
        if length is not None:
            if magic == b"OggS":
                tried = start + length
            yield Found(_RIFF_FORMS[blob[start + 8 : start + 12]] if kind == "riff" else kind, start, length)


def sniff(blob: bytes, declared: str) -> tuple[str, bool, list[Found]]:
    """The corrected type, whether a structure confirmed it, and the embedded media."""
    found = list(scan(blob))
    own = next((f for f in found if f.start == 0), None)
    return (own.kind if own else declared), own is not None, [f for f in found if f is not own]


def carve(blob: bytes, found: Found) -> bytes:
    return blob[found.start : found.start + found.length]


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def wav_samples(blob: bytes) -> bytes:
    """The data chunk of a WAVE file of 8-bit samples."""
    p = 12
    while p + 8 <= len(blob):
        name, size = struct.unpack_from("<4sI", blob, p)
        if name == b"data":
            return blob[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no data chunk")


def features(payload: bytes) -> str:
    """Level, roughness and eight band sums of the samples, in integers, so equal samples give equal strings."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    energy = int((x * x).sum())
    rough = int(np.abs(np.diff(x)).sum())
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    parts = x[: x.size // 8 * 8].reshape(8, -1).sum(axis=1).tolist()
    return f"n={x.size};energy={energy};rough={rough};crossings={crossings};bands={','.join(map(str, parts))}"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's bytes, filled up with blanks to a multiple of BLOCK, as a WAVE file."""

    def start():
        def work(ids: list, texts: list[str]) -> list:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            return [ids, [len(r) for r in raw], [declared] * len(ids), [to_wav(r.ljust(max(1, -(-len(r) // BLOCK)) * BLOCK)) for r in raw]]

        return work

    return map_texts(df, "doc_id long, n_bytes long, declared string, media binary", start, id_col, text_col)


def read_media(media: DataFrame) -> DataFrame:
    """Sniff, read back and describe the rows of store_texts()."""
    schema = T.StructType.fromDDL(
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, valid boolean, n_embedded long"
    )
    out = arrow_schema(schema)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, declared, blob in zip(*batch.columns, strict=True):
                blob = blob.as_py()
                kind, valid, embedded = sniff(blob, declared.as_py())
                payload = wav_samples(blob) if kind == "audio/wav" else blob
                rows.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), features(payload), kind, valid, len(embedded)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def carve_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each valid medium in the column's blobs: doc_id, start, length, media_type, blob."""
    schema = T.StructType.fromDDL("doc_id long, start long, length long, media_type string, blob binary")
    out = arrow_schema(schema)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, blob in zip(*batch.columns, strict=True):
                blob = blob.as_py() or b""
                for f in scan(blob):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((doc_id.as_py(), f.start, f.length, f.kind, carve(blob, f)), out.types, strict=True)], schema=out)

    from pyspark.sql import functions as F

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{media_col}`").cast("binary")).mapInArrow(run, schema)
