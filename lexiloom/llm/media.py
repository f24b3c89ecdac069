"""ISO base media files: boxes are walked, sample tables decoded, payloads never.

`describe` reads a file's structure only (box headers and the tables under `moov`);
`read_samples` fetches stored bytes by those tables; `write_pcm` stores bytes losslessly
as unsigned 8-bit PCM, so that any text can be kept as a media column.

Defined results: a null or empty blob, a blob that is no ISO media file or one whose boxes
overrun it, nest too deeply, or hold tables that contradict each other gives a row with null features and `error` set; nothing is raised.
Features are those of the first track, and in `streams` of all; samples of fragments (moof) follow those of the movie box. Empty
tables give empty results, repeated rows repeated results, extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels as K

#: Bytes of a stored frame, frames of a chunk, and frames from one sync sample to the next.
FRAME, CHUNK_FRAMES, SYNC_EVERY, RATE = 576, 8, 16, 8000
#: Boxes within boxes, at most.
DEEPEST = 32
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data if len(data) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(data)) + data


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, box start, body start, body end) of every box, containers before their contents."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box's 64-bit size is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} overruns its parent")
        here = (*path, kind)
        yield here, start, start + head, start + size
        open_.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(here) > DEEPEST:
                raise ValueError(f"boxes nest more than {DEEPEST} deep")
            open_.append((start + head, start + size, here))


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] | tuple[int, int] = (0, 0)
    chunks: list[int] = field(default_factory=list)
    per_chunk: list[tuple[int, int]] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)
    sync: list[int] | None = None
    number: int = 0
    #: (duration, size, flags) of a fragment's sample that says nothing of its own, and (offset, size, keyframe) of all fragments' samples.
    defaults: tuple[int, int, int] = (0, 0, 0)
    later: list[tuple[int, int, bool]] = field(default_factory=list)
    later_duration: int = 0

    @property
    def in_tables(self) -> int:
        return self.sizes[1] if isinstance(self.sizes, tuple) else len(self.sizes)

    @property
    def count(self) -> int:
        return self.in_tables + len(self.later)

    @property
    def whole_duration(self) -> int:
        return self.duration + self.later_duration

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, size) of every sample."""
        return self.table_ranges() + [(a, n) for a, n, _ in self.later]

    def table_ranges(self) -> list[tuple[int, int]]:
        """(offset, size) of every sample, from the chunk, sample-to-chunk and size tables."""
        out, n, total = [], 0, self.in_tables
        fixed = self.sizes[0] if isinstance(self.sizes, tuple) else None
        for k, (first, per) in enumerate(self.per_chunk):
            if n >= total:
                break
            last = self.per_chunk[k + 1][0] if k + 1 < len(self.per_chunk) else len(self.chunks) + 1
            for at in self.chunks[first - 1 : last - 1]:
                for _ in range(min(per, total - n)):
                    size = fixed if fixed is not None else self.sizes[n]
                    out.append((at, size))
                    at += size
                    n += 1
        return out

    def keyframes(self) -> list[tuple[int, int]]:
        every = self.table_ranges()
        found = every if self.sync is None else [every[i - 1] for i in self.sync if 0 < i <= len(every)]
        return found + [(a, n) for a, n, key in self.later if key]


def _table(data: bytes, at: int, end: int, what: str) -> list[tuple[int, ...]]:
    (n,) = struct.unpack_from(">I", data, at)
    if at + 4 + n * struct.calcsize(">" + what) > end:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(">" + what, data[at + 4 : at + 4 + n * struct.calcsize(">" + what)]))


def _compact_sizes(data: bytes, at: int, end: int) -> list[int]:
    """The sizes of an stz2 table, of 4, 8 or 16 bits each."""
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > end:
        raise ValueError("a table of compact sizes is cut off")
    body = data[at + 12 : at + 12 + (n * bits + 7) // 8]
    if bits == 4:
        return [x for byte in body for x in (byte >> 4, byte & 15)][:n]
    return [x for (x,) in struct.iter_unpack(">B" if bits == 8 else ">H", body)]


def _run(data: bytes, at: int, end: int, base: int, defaults: tuple[int, int, int]) -> tuple[list[tuple[int, int, bool]], int, int]:
    """A track run: its samples, their duration, and where it ends; base is where it begins, or what its own offset counts from."""
    flags, n = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    fields = [bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800)]
    if flags & 1:
        base += struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    if at + 4 * sum(fields) * n > end or n > len(data):
        raise ValueError("a track run is cut off")
    out, total = [], 0
    for k in range(n):
        found = list(defaults)
        if k == 0 and first is not None:
            found[2] = first
        for i, there in enumerate(fields):
            if there:
                if i < 3:
                    (found[i],) = struct.unpack_from(">I", data, at)
                at += 4
        out.append((base, found[1], not found[2] & 0x10000))
        base += found[1]
        total += found[0]
    return out, total, base


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file; ValueError if it is no ISO media file."""
    found: list[Track] = []
    brand = False
    part = moof = run_at = 0
    here: Track | None = None  # of the fragment
    defaults = (0, 0, 0)
    own_base = False
    try:
        for path, start, at, end in walk(data):
            kind = path[-1]
            brand |= path == (b"ftyp",)
            if path == (b"moov", b"trak"):
                found.append(Track())
            elif path == (b"moof",):
                moof = run_at = start
            elif path == (b"moov", b"mvex", b"trex"):
                number, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
                for t in found:
                    if t.number == number:
                        t.defaults = (duration, size, flags)
            elif path == (b"moof", b"traf", b"tfhd"):
                flags, number = struct.unpack_from(">II", data, at)
                part, here = at + 8, next((t for t in found if t.number == number), None)
                own = list(here.defaults if here else (0, 0, 0))
                own_base = bool(flags & 1)
                if own_base:
                    (run_at,) = struct.unpack_from(">Q", data, part)
                    part += 8
                elif flags & 0x20000:
                    run_at = moof
                if flags & 2:
                    part += 4
                for i, bit in enumerate((8, 16, 32)):
                    if flags & bit:
                        (own[i],) = struct.unpack_from(">I", data, part)
                        part += 4
                defaults, own_base = (own[0], own[1], own[2]), own_base or bool(flags & 0x20000)
                base = run_at
            elif path == (b"moof", b"traf", b"trun"):
                if here is None:
                    raise ValueError("a fragment of no track")
                relative = struct.unpack_from(">I", data, at)[0] & 1
                samples, duration, run_at = _run(data, at, end, (base if own_base else moof) if relative else run_at, defaults)
                here.later += samples
                here.later_duration += duration
            elif path[:2] != (b"moov", b"trak"):
                continue
            elif kind == b"tkhd":
                (found[-1].number,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
            elif kind == b"mdhd":
                wide = data[at] == 1
                found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            elif kind == b"hdlr":
                found[-1].kind = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                found[-1].codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stts":
                found[-1].times = _table(data, at + 4, end, "II")
            elif kind == b"stsc":
                found[-1].per_chunk = [(a, b) for a, b, _ in _table(data, at + 4, end, "III")]
            elif kind == b"stsz":
                (size,) = struct.unpack_from(">I", data, at + 4)
                found[-1].sizes = (size, struct.unpack_from(">I", data, at + 8)[0]) if size else [x for (x,) in _table(data, at + 8, end, "I")]
            elif kind == b"stz2":
                found[-1].sizes = _compact_sizes(data, at, end)
            elif kind == b"stco":
                found[-1].chunks = [x for (x,) in _table(data, at + 4, end, "I")]
            elif kind == b"co64":
                found[-1].chunks = [x for (x,) in _table(data, at + 4, end, "Q")]
            elif kind == b"stss":
                found[-1].sync = [x for (x,) in _table(data, at + 4, end, "I")]
    except (struct.error, IndexError) as e:
        raise ValueError(f"a box is cut off: {e}") from e
    if not brand or not found:
        raise ValueError("no ftyp box or no track")
    for t in found:
        if t.count > len(data) or any(not 0 <= a <= a + n <= len(data) for a, n in t.ranges()):
            raise ValueError("a sample lies outside the file")
    return found


def read_samples(data: bytes, track: Track) -> bytes:
    """The track's stored bytes in sample order; neighbouring samples are read at once."""
    parts, lo, hi = [], 0, 0
    for at, size in track.ranges():
        if at != hi:
            parts.append(data[lo:hi])
            lo = at
        hi = at + size
    return b"".join([*parts, data[lo:hi]])


def write_pcm(payload: bytes) -> bytes:
    """An ISO media file with the payload as unsigned 8-bit mono PCM, in frames of FRAME samples; no clock or random number enters it."""
    n = -(-len(payload) // FRAME)
    if n * FRAME != len(payload):
        raise ValueError(f"a payload has whole frames of {FRAME} bytes")
    duration, chunks = len(payload), -(-n // CHUNK_FRAMES)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    unit = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    rest = n - (chunks - 1) * CHUNK_FRAMES
    stsc = [(1, CHUNK_FRAMES, 1), (chunks, rest, 1)] if chunks > 1 and rest != CHUNK_FRAMES else [(1, min(n, CHUNK_FRAMES), 1)]
    sync = range(1, n + 1, SYNC_EVERY)
    wide = len(payload) > 2**31

    def moov(at: int) -> bytes:
        offsets = [at + k * CHUNK_FRAMES * FRAME for k in range(chunks)]
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, FRAME)),
            full(b"stss", struct.pack(f">{len(sync) + 1}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)) if wide else full(b"stco", struct.pack(f">{chunks + 1}I", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQI", 0, 0, RATE, duration, 0x55C40000), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), unit, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, duration, 0x10000, 256), bytes(10), unit, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) >= 2**32 - 8 else 8)
    return b"".join([ftyp, moov(head), box(b"mdat", payload)])


def _features(t: Track) -> dict:
    return {
        "codec": t.codec, "handler": t.kind, "timescale": t.timescale, "duration_s": t.whole_duration / t.timescale if t.timescale else None,
        "samples": t.count, "keyframes": [{"offset": a, "bytes": n} for a, n in t.keyframes()],
    }


def describe(data: bytes | None) -> dict:
    """Codec, seconds, samples and keyframe byte ranges of the first track, and of all in `streams`."""
    if not data:
        return {"error": "no data"}
    try:
        streams = [_features(t) for t in tracks(data)]
    except (ValueError, OverflowError) as e:
        return {"error": str(e)}
    return streams[0] | {"tracks": len(streams), "streams": streams, "error": None}


_KEYS = "keyframes array<struct<offset:long,bytes:long>>"
_STREAM = "codec:string,handler:string,timescale:long,duration_s:double,samples:long," + _KEYS.replace(" ", ":", 1)
FEATURES = f"codec string, handler string, tracks int, timescale long, duration_s double, samples long, {_KEYS}, streams array<struct<{_STREAM}>>, error string"
_KEYS_ARROW = pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))
_STREAM_ARROW = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", _KEYS_ARROW)]))
_ARROW = pa.schema([("id", pa.int64()), ("codec", pa.string()), ("handler", pa.string()), ("tracks", pa.int32()), ("timescale", pa.int64()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", _KEYS_ARROW), ("streams", _STREAM_ARROW), ("error", pa.string())])


def media_features(df: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """One row of features per media blob, in one map over the input, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"id": i} | describe(d) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(blob_col).cast("binary").alias("blob")).mapInArrow(K.calm(run), f"id long, {FEATURES}")


TEXT_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:long,bytes:long>>"
_TEXT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])))])


def store_text(text: bytes) -> bytes:
    """The media file of a text: its bytes, then bytes 255 up to a positive multiple of FRAME."""
    frames = max(1, -(-len(text) // FRAME))
    return write_pcm(text.ljust(frames * FRAME, b"\xff"))


def _text_row(doc_id: int | None, text: bytes | None) -> tuple:
    text = text or b""
    media = store_text(text)
    track = tracks(media)[0]
    payload = read_samples(media, track)
    keys = track.keyframes()
    seconds = track.duration / track.timescale
    return (
        doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(),
        f"{track.codec.strip()};{seconds:.6f};{track.count};" + ",".join(f"{a}+{n}" for a, n in keys), track.codec.strip(), seconds, [{"offset": a, "bytes": n} for a, n in keys],
    )


def texts_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text in a media file, read it back by its sample tables, and return digests and features.

    A null text counts as empty, equal texts give equal values, a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                rows = [_text_row(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXT_ARROW)], schema=_TEXT_ARROW)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(K.calm(run), TEXT_SCHEMA)
