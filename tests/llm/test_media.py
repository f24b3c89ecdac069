import hashlib
import random
import struct
import zlib

import pytest

from lexiloom.llm import media, queries

TEXTS = [None, "", "a", "é" * 300, "x" * 576, "x" * 577, "y" * 50_000, "a", "\u0000"]


def payload(text):
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 16, 17, 100])
def test_round_trip_through_sample_tables(n):
    data = bytes(i * 31 % 256 for i in range(n * 576))
    blob = media.write_pcm(data)
    (track,) = media.tracks(blob)
    assert media.read_samples(blob, track) == data
    found = media.describe(blob)
    assert (found["codec"], found["samples"], found["duration_s"]) == ("raw ", n, n * 576 / 8000)
    first = blob.index(b"mdat") + 4
    assert [(k["offset"], k["bytes"]) for k in found["keyframes"]] == [(first + i * 576, 576) for i in range(0, n, 16)]


def test_boxes_of_64_bit_and_open_size():
    blob = media.write_pcm(b"z" * 1152)
    at = blob.index(b"mdat") - 4
    wide = blob[:at] + struct.pack(">I4sQ", 1, b"mdat", 16 + 1152) + blob[at + 8 :]
    assert [p[-1] for p, *_ in media.walk(wide)][-1] == b"mdat"
    open_ended = blob[:at] + struct.pack(">I", 0) + blob[at + 4 :]
    assert media.describe(open_ended)["samples"] == 2


def test_tables_with_varying_sizes_and_wide_offsets():
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))),
        media.full(b"stsz", struct.pack(">II3I", 0, 3, 5, 7, 9)),
        media.full(b"stsc", struct.pack(">I3I3I", 2, 1, 2, 1, 2, 1, 1)),
        media.full(b"co64", struct.pack(">I2Q", 2, 10, 30)),
        media.full(b"stss", struct.pack(">I2I", 2, 1, 3)),
    )
    mdhd = media.full(b"mdhd", struct.pack(">IIII", 0, 0, 90000, 45000), bytes(4))
    blob = media.box(b"ftyp", b"isom", bytes(4)) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    found = media.describe(blob)
    assert (found["codec"], found["duration_s"], found["samples"]) == ("avc1", 0.5, 3)
    assert [(k["offset"], k["bytes"]) for k in found["keyframes"]] == [(10, 5), (30, 9)]


def fragmented(default_size=4):
    """Two tracks; a movie fragment has three samples of the second, the first and last of them keyframes."""
    def trak(number, codec, handler):
        tkhd = media.full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(68))
        mdhd = media.full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4))
        stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(20))), media.full(b"stz2", struct.pack(">II", 4, 0)))
        return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, media.full(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", stbl)))

    trex = media.full(b"trex", struct.pack(">5I", 2, 1, 40, default_size, 0x10000))
    moov = media.box(b"moov", trak(1, b"mp4a", b"soun"), trak(2, b"avc1", b"vide"), media.box(b"mvex", trex))

    def moof(at):
        tfhd = media.full(b"tfhd", struct.pack(">I", 2), flags=0x20000)
        trun = media.full(b"trun", struct.pack(">IiIII", 2, at, 0, 5, 6), flags=0x1 | 0x4 | 0x200)
        more = media.full(b"trun", struct.pack(">III", 1, 40, 0), flags=0x100 | 0x400)
        return media.box(b"moof", media.full(b"mfhd", bytes(4)), media.box(b"traf", tfhd, trun, more))

    head = media.box(b"ftyp", b"isom", bytes(4)) + moov
    return head + moof(len(moof(0)) + 8) + media.box(b"mdat", b"AAAAABBBBBBCCCC"), len(head) + len(moof(0)) + 8


def test_fragments_and_all_tracks():
    blob, at = fragmented()
    found = media.describe(blob)
    assert (found["error"], found["tracks"], found["codec"], found["samples"]) == (None, 2, "mp4a", 0)
    video = found["streams"][1]
    assert (video["codec"], video["handler"], video["samples"], video["duration_s"]) == ("avc1", "vide", 3, 0.12)
    assert [(k["offset"], k["bytes"]) for k in video["keyframes"]] == [(at, 5), (at + 11, 4)]
    assert media.read_samples(blob, media.tracks(blob)[1]) == b"AAAAABBBBBBCCCC"
    assert media._compact_sizes(bytes(7) + b"\x04" + struct.pack(">I", 3) + b"\x12\x30", 0, 14) == [1, 2, 3]


def test_crafted_blobs_raise_nothing():
    empty = media.box(b"ftyp", b"isom") + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd"))))
    assert media.describe(empty)["error"]
    deep = b""
    for _ in range(2000):
        deep = media.box(b"moov", deep)
    assert "deep" in media.describe(media.box(b"ftyp", b"isom") + deep)["error"]
    rng = random.Random(3)
    for good in (media.write_pcm(b"q" * 5760), fragmented()[0]):
        errors = 0
        for _ in range(3000):
            b = bytearray(good)
            for _ in range(rng.randint(1, 6)):
                b[rng.randrange(min(len(b), 900))] = rng.choice([0, 1, 2, 127, 255, rng.randrange(256)])
            errors += media.describe(bytes(b[: rng.choice([len(b), rng.randrange(len(b))])]))["error"] is not None
        assert errors > 300


def test_broken_blobs_give_an_error_and_no_row_is_lost(spark):
    good = media.write_pcm(b"q" * 576)
    blobs = [None, b"", b"nonsense", good[:-1], good[:300], good, bytes(100), media.box(b"ftyp", b"isom")]
    rows = {r.id: r for r in media.media_features(spark.createDataFrame(list(enumerate(map(lambda b: b and bytearray(b), blobs))), "i long, b binary"), "i", "b").collect()}
    assert len(rows) == len(blobs)
    assert [i for i, r in rows.items() if r.error is None] == [5]


def test_texts(docs):
    rows = {r.doc_id: r for r in media.texts_as_media(docs(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        p, r = payload(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        blob = media.write_pcm(p)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
    assert rows[2][1:] == rows[7][1:]
    assert media.texts_as_media(docs([])).count() == 0


def test_query_over_a_whole_table(spark):
    from tests.llm.common import SMALL, table

    texts = dict(table("documents")[["doc_id", "text"]].itertuples(index=False))
    got = queries.op9_media(spark, SMALL).collect()
    assert len(got) == len(texts)
    assert all(r.payload_sha256 == hashlib.sha256(payload(texts[r.doc_id])).hexdigest() for r in got)
