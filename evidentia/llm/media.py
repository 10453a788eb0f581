"""Media columns in ISO base media containers.

Texts are stored as 8-bit samples: 64 bytes are one 8 by 8 grey frame of an
uncompressed video track. The reader is general: it walks nested boxes of any
ISO media file, decodes the sample tables (durations, sizes, chunks, offsets,
sync samples) and returns codec, duration and the byte ranges of keyframes
without touching the payloads. Samples of movie fragments (moof, traf, trun)
follow those of the sample tables, in the order of the fragments.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import Scratch, documents, utf8

FRAME, CHUNK_FRAMES, KEY_EVERY, TIMESCALE = 64, 16, 16, 25
#: Fixed by the format: boxes that hold boxes, and 64-bit limits.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"])
SHORT, LONG = 1 << 32, 1 << 63
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
TRACK = "struct<handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,sample_bytes:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>"


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``FRAME``."""
    return data + bytes(-len(data) % FRAME if data else FRAME)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < SHORT else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _movie(frames: int, first: int, wide: bool) -> bytes:
    """The moov box for ``frames`` frames that begin at byte ``first`` of the file."""
    chunks, rest = divmod(frames, CHUNK_FRAMES)
    sizes = [(1, CHUNK_FRAMES)] * bool(chunks) + [(chunks + 1, rest)] * bool(rest)
    offsets = [first + i * CHUNK_FRAMES * FRAME for i in range(chunks + bool(rest))]
    keys = range(1, frames + 1, KEY_EVERY)
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32),
        struct.pack(">Hh", 40, -1),
    )
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, frames, 1)),
        full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(sizes)), *(struct.pack(">III", at, n, 1) for at, n in sizes)),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
    )
    data = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, frames, 0x55C4, 0), version=1),
        full(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0"),
        box(b"minf", full(b"vmhd", bytes(8), flags=1), data, table),
    )
    header = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), version=1, flags=3)
    movie = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return box(b"moov", movie, box(b"trak", header, media))


def encode(data: bytes) -> bytes:
    """An ISO media file that holds ``data``, padded, as frames."""
    payload = padded(data)
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    frames, wide = len(payload) // FRAME, len(payload) > SHORT - (1 << 26)
    head = len(kind) + len(_movie(frames, 0, wide)) + (16 if len(payload) + 8 >= SHORT else 8)
    return kind + _movie(frames, head, wide) + box(b"mdat", payload)


def boxes(data: memoryview, first: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of the boxes in a range."""
    while first < end:
        if end - first < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, first)
        body = first + 8
        if size == 1:
            if end - first < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - first
        if size < body - first or first + size > end:
            raise ValueError(f"the box {kind!r} does not fit")
        yield kind, body, first + size
        first += size


def walk(data: memoryview, first: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of all boxes, containers before what they hold. Path
    elements are (kind, number within its kind)."""
    count: dict[bytes, int] = {}
    for kind, a, b in boxes(data, first, end):
        here = (*path, (kind, count.get(kind, 0)))
        count[kind] = count.get(kind, 0) + 1
        yield here, a, b
        if kind in CONTAINERS and len(here) < 16:
            yield from walk(data, a, b, here)


class Room:
    """How many samples a file can still have. What a table claims is held against the
    bytes of the file before anything is allocated for it: a sample has a byte
    of its own, or an entry in a table; samples that share bytes are refused."""

    def __init__(self, size: int) -> None:
        self.size = self.left = size

    def take(self, samples: int, each: int = 0) -> None:
        self.left -= samples
        if self.left < 0 or samples * each > self.size:
            raise ValueError("more samples than the file has bytes")


def _table(data: memoryview, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """Entries of a table box: a count and rows of ``width`` big-endian numbers. Numbers
    too large for a signed long become the largest one that is safe to add to."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = np.dtype(kind).itemsize * width
    if at + 8 + n * size > end:
        raise ValueError("a table is cut off")
    found = np.frombuffer(data, kind, n * width, at + 8)
    return np.minimum(found, 1 << 62).astype(np.int64).reshape(n, width) if kind == ">u8" else found.astype(np.int64).reshape(n, width)


def sample_ranges(data: memoryview, table: dict[bytes, tuple[int, int]], room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of every sample, from the tables of one track."""
    a, end = table[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    room.take(n, fixed)
    lengths = np.full(n, fixed, np.int64) if fixed else _table(data, a + 4, end, ">u4")[:, 0]
    wide = b"co64" in table
    chunks = _table(data, *table[b"co64" if wide else b"stco"], ">u8" if wide else ">u4")[:, 0]
    runs = _table(data, *table[b"stsc"], ">u4", 3)
    if not n:
        return lengths, lengths
    firsts = runs[:, 0]
    if not len(runs) or firsts[0] != 1 or (firsts[1:] <= firsts[:-1]).any() or firsts[-1] > len(chunks):
        raise ValueError("runs of chunks are not in order")
    until = np.concatenate([firsts[1:] - 1, [len(chunks)]])
    each = np.minimum(np.repeat(runs[:, 1], until - firsts + 1), n)
    through = np.cumsum(each)
    if through[-1] < n:
        raise ValueError("chunks hold fewer samples than there are")
    chunk = np.searchsorted(through, np.arange(n), side="right")
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    begins = through - each
    return chunks[chunk] + before - before[np.minimum(begins[chunk], n - 1)], lengths


#: Fixed by the format: what a track fragment's header and run say, by flag.
BASE, DESCRIPTION, DURATION, SIZE, FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_AT, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


def fragment_samples(data: memoryview, start: int, first: int, end: int, defaults: dict[int, tuple[int, int, int]], room: Room) -> dict[int, list[np.ndarray]]:
    """Rows (offset, length, duration, is key) by track of the moof box that begins at
    ``start``, whose body is ``first`` to ``end``; ``defaults`` are those of trex."""
    found: dict[int, list[np.ndarray]] = {}
    previous = start
    for kind, a, b in boxes(data, first, end):
        if kind != b"traf":
            continue
        track, base, duration, size, flags, at = 0, start, 0, 0, 0, None
        for inner, x, y in boxes(data, a, b):
            told = struct.unpack_from(">I", data, x)[0] & 0xFFFFFF
            if inner == b"tfhd":
                (track,) = struct.unpack_from(">I", data, x + 4)
                duration, size, flags = defaults.get(track, (0, 0, 0))
                p = x + 8
                base = start if told & FROM_MOOF else previous
                if told & BASE:
                    (base,) = struct.unpack_from(">Q", data, p)
                    p += 8
                p += 4 * bool(told & DESCRIPTION)
                if told & DURATION:
                    (duration,) = struct.unpack_from(">I", data, p)
                    p += 4
                if told & SIZE:
                    (size,) = struct.unpack_from(">I", data, p)
                    p += 4
                if told & FLAGS:
                    (flags,) = struct.unpack_from(">I", data, p)
            elif inner == b"trun":
                (n,) = struct.unpack_from(">I", data, x + 4)
                p, own_first = x + 8, None
                if told & RUN_AT:
                    at = base + struct.unpack_from(">i", data, p)[0]
                    p += 4
                if told & RUN_FIRST:
                    (own_first,) = struct.unpack_from(">I", data, p)
                    p += 4
                columns = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if told & f]
                if p + 4 * n * len(columns) > y:
                    raise ValueError("a run of samples is cut off")
                room.take(n, 0 if RUN_SIZE in columns else size)
                rows = np.frombuffer(data, ">u4", n * len(columns), p).astype(np.int64).reshape(n, len(columns)) if columns else np.zeros((n, 0), np.int64)
                of = lambda f, other: rows[:, columns.index(f)] if f in columns else np.full(n, other, np.int64)
                lengths, marks = of(RUN_SIZE, size), of(RUN_FLAGS, flags).copy()
                if own_first is not None and n:
                    marks[0] = own_first
                origin = base if at is None else at
                if n and not 0 <= origin <= len(data):
                    raise ValueError("a sample lies outside the file")
                offsets = (origin if n else 0) + np.cumsum(lengths) - lengths
                at = int(offsets[-1] + lengths[-1]) if n else at
                previous = at if at is not None else previous
                found.setdefault(track, []).append(np.stack([offsets, lengths, of(RUN_DURATION, duration), (marks & NOT_SYNC) == 0], axis=1))
    return found


def _duration(steps: np.ndarray, more: int) -> int:
    """The sum of a table of (samples, duration), and more."""
    total = more + sum(n * step for n, step in steps.tolist())
    if total >= LONG:
        raise ValueError("a duration is too large")
    return total


def describe(file: bytes) -> list[dict]:
    """Tracks of an ISO media file; raises ValueError where it is malformed, and where its
    tables claim more samples, or samples of more bytes, than the file has. The
    duration is null where the file says that it is unknown."""
    data, room = memoryview(file), Room(len(file))
    tracks: dict[tuple, dict[bytes, tuple[int, int]]] = {}
    try:
        defaults: dict[int, tuple[int, int, int]] = {}
        moofs, start = [], 0
        for kind, a, b in boxes(data, 0, len(data)):
            if kind == b"moof":
                moofs.append((start, a, b))
            start = b
        for path, a, b in walk(data, 0, len(data)):
            if len(path) > 2 and path[0][0] == b"moov" and path[1][0] == b"trak":
                tracks.setdefault(path[:2], {})[path[-1][0]] = (a, b)
            elif [k for k, _ in path] == [b"moov", b"mvex", b"trex"]:
                track, _, *rest = struct.unpack_from(">5I", data, a + 4)
                defaults[track] = tuple(rest)
        parts: dict[int, list[np.ndarray]] = {}
        for at in moofs:
            for track, rows in fragment_samples(data, *at, defaults, room).items():
                parts.setdefault(track, []).extend(rows)
        out = []
        for found in tracks.values():
            at = found[b"mdhd"][0]
            scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
            if duration == (1 << 64 if data[at] else SHORT) - 1:
                duration = None
            elif duration >= LONG:
                raise ValueError("a duration is too large")
            track = None
            if parts:
                header = found[b"tkhd"][0]
                (track,) = struct.unpack_from(">I", data, header + (20 if data[header] else 12))
            offsets, lengths = sample_ranges(data, found, room)
            steps = _table(data, *found[b"stts"], ">u4", 2)
            length = _duration(steps, 0)
            keys = _table(data, *found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(len(offsets))
            if track in parts:
                rows = np.concatenate(parts[track])
                keys = np.concatenate([keys, len(offsets) + np.flatnonzero(rows[:, 3])])
                offsets, lengths = np.concatenate([offsets, rows[:, 0]]), np.concatenate([lengths, rows[:, 1]])
                length = _duration(steps, int(rows[:, 2].sum()))
            if len(offsets) and offsets.min() < 0:
                raise ValueError("a sample lies outside the file")
            if len(offsets) and (offsets + lengths).max() > len(data):
                raise ValueError("a sample lies outside the file")
            if lengths.sum() > len(data):
                raise ValueError("samples share bytes")
            if len(keys) and not 0 <= keys.min() <= keys.max() < len(offsets):
                raise ValueError("a keyframe is no sample")
            out.append({
                "handler": bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1"),
                "codec": bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1"),
                "timescale": scale, "duration": length or duration,
                "samples": len(offsets), "sample_bytes": int(lengths.sum()), "offsets": offsets, "lengths": lengths,
                "keyframes": [{"offset": int(offsets[k]), "length": int(lengths[k])} for k in keys],
            })
        return out
    except (struct.error, KeyError, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"malformed: {e!r}") from e


def payload_of(file: bytes, track: dict) -> bytes:
    """The samples of a track, one after the other."""
    offsets, lengths = track["offsets"], track["lengths"]
    if not len(offsets):
        return b""
    joins = np.flatnonzero(offsets[1:] != offsets[:-1] + lengths[:-1]) + 1
    first = np.concatenate([[0], joins])
    last = np.concatenate([joins - 1, [len(offsets) - 1]])
    return b"".join(file[offsets[a] : offsets[b] + lengths[b]] for a, b in zip(first, last))


def media(text: Column) -> Column:
    """Whole texts (null: empty) as ISO media files."""

    @arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([encode(utf8(t.as_py())) for t in column], pa.binary())

    return of(text)


KEYFRAMES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
TRACK_ARROW = pa.struct([
    ("handler", pa.string()), ("codec", pa.string()), *((k, pa.int64()) for k in ("timescale", "duration", "samples", "sample_bytes")),
    ("keyframes", KEYFRAMES),
])
READ = f"struct<tracks:array<{TRACK}>,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,error:string>"
READ_ARROW = pa.struct([
    ("tracks", pa.list_(TRACK_ARROW)), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string()),
])


def _tables(found: list[dict]) -> list[dict]:
    return [{k: v for k, v in t.items() if k not in ("offsets", "lengths")} for t in found]


def tracks(file: Column) -> Column:
    """Struct of ``tracks`` and ``error`` for a column of ISO media files. A null,
    malformed file, and one without a track, has no tracks and an error that says
    why; so does one whose numbers claim more than it holds. Payloads are not touched."""

    @arrow_udf(f"struct<tracks:array<{TRACK}>,error:string>")
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            try:
                found = describe(value.as_py() or b"")
                if not found:
                    raise ValueError("no track")
                rows.append({"tracks": _tables(found), "error": None})
            except ValueError as e:
                rows.append({"tracks": None, "error": str(e)})
        return pa.array(rows, pa.struct([("tracks", pa.list_(TRACK_ARROW)), ("error", pa.string())]))

    return of.asNondeterministic()(file)


def contents(file: Column) -> Column:
    """Struct of :func:`tracks` and of digests of the first track's payload, read back
    by its sample tables; each file is parsed once. Of a file with an error all
    but ``error`` and, where it is not null, ``media_bytes`` and
    ``media_sha256`` is null."""

    @arrow_udf(READ)
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            data, row = value.as_py(), dict.fromkeys(READ_ARROW.names)
            try:
                if data is None:
                    raise ValueError("null")
                row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                found = describe(data)
                if not found:
                    raise ValueError("no track")
                payload = payload_of(data, found[0])
                row |= {
                    "tracks": _tables(found), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-FRAME:]),
                }
            except ValueError as e:
                row["error"] = str(e)
            rows.append(row)
        return pa.array(rows, READ_ARROW)

    return of.asNondeterministic()(file)


def store(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of ``doc_id``, ``n_bytes`` and ``media`` for every row of
    ``docs`` (``doc_id``, ``text``; other columns are ignored)."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return scratch.keep(docs.select("doc_id", size.alias("n_bytes"), media(F.col("text")).alias("media")), "media")


def catalogue(stored: DataFrame) -> DataFrame:
    """Codec, duration and keyframe ranges of the first track of each stored file
    (``doc_id``, ``n_bytes``, ``media``), and digests of its payload; rows as often
    as they are in the table. A file that is null or can't be read is a row with
    an ``error`` and no ``track``; an empty table gives no rows."""
    read = stored.select("doc_id", "n_bytes", contents(F.col("media")).alias("c"))
    digests = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
    return read.select("doc_id", "n_bytes", *(f"c.{d}" for d in digests), F.get("c.tracks", 0).alias("track"))


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` stored and read back, a row a row of the table; null and empty
    texts are one frame of zeros; an empty table gives no rows."""
    found = catalogue(store(documents(spark, sf_dir), Scratch(spark, "media")))
    keys = F.col("track.keyframes")
    ends = lambda k: F.concat(k["offset"].cast("string"), F.lit("+"), k["length"].cast("string"))
    feature = F.concat_ws(
        ";", F.trim("track.codec"), F.concat("track.duration", F.lit("/"), "track.timescale"), "track.samples",
        F.size(keys).cast("string"), ends(F.get(keys, 0)), ends(F.element_at(keys, -1)),
    )
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
