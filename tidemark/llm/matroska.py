"""Media columns: Matroska files in binary columns, parsed into packet tables.

The reader walks EBML elements (variable-length ids and sizes, unknown sizes included), the segment's information,
tracks, clusters with simple blocks and block groups, all kinds of lacing, and cues. A packet is one frame: its track,
timestamp and byte range in the file. The writer makes files of one uncompressed 8-bit audio track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Element ids of the format.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class MatroskaError(ValueError):
    pass


def read_vint(data: memoryview, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, all value bits set) of the variable-length integer at a position."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length integer at {at}")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise MatroskaError(f"variable-length integer cut off at {at}")
    value = int.from_bytes(data[at : at + size], "big")
    bits = value & ((1 << 7 * size) - 1)
    return (value if keep_marker else bits), at + size, bits == (1 << 7 * size) - 1


def write_vint(value: int, size: int = 0) -> bytes:
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: int
    cluster_at: int
    start: int
    length: int


@dataclass
class Media:
    doc_type: str = ""
    scale_ns: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position
    clusters: list[int] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)


def elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end). An element of unknown size ends where its parent does or a sibling of a higher level begins."""
    while at < end:
        begin = at
        ident, at, _ = read_vint(data, at, keep_marker=True)
        size, body, unknown = read_vint(data, at)
        if unknown:
            stop = end
            if ident == CLUSTER:
                stop = next((b for i, b, _, _ in _siblings(data, body, end) if i in TOP_LEVEL), end)
        else:
            stop = body + size
            if stop > end:
                raise MatroskaError(f"element {ident:x} at {begin} reaches past its parent")
        yield ident, begin, body, stop
        at = stop


def _siblings(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    while at < end:
        begin = at
        ident, at, _ = read_vint(data, at, keep_marker=True)
        size, body, unknown = read_vint(data, at)
        yield ident, begin, body, body if unknown else body + size
        if unknown:
            return
        at = body + size


def _uint(data: memoryview, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: memoryview, at: int, end: int) -> float:
    return 0.0 if at == end else struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0]


def _text(data: memoryview, at: int, end: int) -> str:
    return bytes(data[at:end]).rstrip(b"\0").decode("utf-8", "replace")


def block_frames(data: memoryview, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, byte ranges of the frames) of a block's body."""
    track, at, _ = read_vint(data, at)
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, flags, [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise MatroskaError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        size, at, _ = read_vint(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            delta, at, _ = read_vint(data, at)
            size += delta - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(size)
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("lace sizes exceed the block")
    frames = []
    for size in sizes:
        frames.append((at, size))
        at += size
    return track, relative, flags, frames


def parse(raw: bytes) -> Media:
    data, media = memoryview(raw), Media()
    for ident, _, body, end in elements(data, 0, len(data)):
        if ident == EBML:
            media.doc_type = next((_text(data, b, e) for i, _, b, e in elements(data, body, end) if i == DOC_TYPE), "")
        elif ident == SEGMENT:
            for child, begin, b, e in elements(data, body, end):
                if child == INFO:
                    for i, _, x, y in elements(data, b, e):
                        if i == TIMESTAMP_SCALE:
                            media.scale_ns = _uint(data, x, y)
                        elif i == DURATION:
                            media.duration = _float(data, x, y)
                elif child == TRACKS:
                    media.tracks += [_track(data, x, y) for i, _, x, y in elements(data, b, e) if i == TRACK_ENTRY]
                elif child == CLUSTER:
                    media.clusters.append(begin)
                    _cluster(data, begin, b, e, media)
                elif child == CUES:
                    media.cues += [cue for i, _, x, y in elements(data, b, e) if i == CUE_POINT for cue in _cue(data, x, y, body)]
    return media


def _track(data: memoryview, at: int, end: int) -> dict:
    out = {"number": 0, "type": 0, "codec": "", "frame_ns": 0, "rate": 0.0, "channels": 1, "bits": 0}
    for i, _, x, y in elements(data, at, end):
        if i in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            out[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns"}[i]] = _uint(data, x, y)
        elif i == CODEC_ID:
            out["codec"] = _text(data, x, y)
        elif i == AUDIO:
            for j, _, p, q in elements(data, x, y):
                if j == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, p, q)
                elif j in (CHANNELS, BIT_DEPTH):
                    out["channels" if j == CHANNELS else "bits"] = _uint(data, p, q)
    return out


def _cue(data: memoryview, at: int, end: int, segment: int) -> list[tuple[int, int, int]]:
    time, found = 0, []
    for i, _, x, y in elements(data, at, end):
        if i == CUE_TIME:
            time = _uint(data, x, y)
        elif i == CUE_TRACK_POSITIONS:
            own = {j: _uint(data, p, q) for j, _, p, q in elements(data, x, y)}
            found.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0) + segment))
    return [(time, track, position) for track, position in found]


def _cluster(data: memoryview, begin: int, at: int, end: int, media: Media) -> None:
    base = 0
    frame_ns = {t["number"]: t["frame_ns"] for t in media.tracks}

    def block(x: int, y: int, keyframe: bool | None, lasting: int | None = None) -> None:
        track, relative, flags, frames = block_frames(data, x, y)
        start = (base + relative) * media.scale_ns
        step = lasting * media.scale_ns // len(frames) if lasting else frame_ns.get(track, 0)
        for k, (p, n) in enumerate(frames):
            media.packets.append(Packet(track, start + k * step, bool(flags & 0x80) if keyframe is None else keyframe, flags >> 1 & 3, begin, p, n))

    for i, _, x, y in elements(data, at, end):
        if i == TIMESTAMP:
            base = _uint(data, x, y)
        elif i == SIMPLE_BLOCK:
            block(x, y, None)
        elif i == BLOCK_GROUP:
            inner = {j: (p, q) for j, _, p, q in elements(data, x, y)}
            if BLOCK in inner:
                block(*inner[BLOCK], REFERENCE_BLOCK not in inner, _uint(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None)


# -- writing -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MuxConfig:
    rate: int = 8000  # samples (bytes) a second
    frame: int = 256  # bytes of a frame; 32 ms
    frames_per_block: int = 8
    blocks_per_cluster: int = 16
    unit: int = 64  # payloads are padded to a positive multiple of this


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def _number(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    if kind == NO_LACING:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += write_vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1]):
            d = now - before
            n = next(k for k in range(1, 9) if abs(d) < (1 << (7 * k - 1)) - 1)
            head += write_vint(d + (1 << (7 * n - 1)) - 1, n)
    return head + b"".join(frames)


def mux(payload: bytes, c: MuxConfig = MuxConfig()) -> bytes:
    """A file with the payload as 8-bit samples. Blocks of equal frames use fixed lacing, the last ones EBML or Xiph lacing or none."""
    ms = c.frame * 1000 // c.rate
    frames = [payload[i : i + c.frame] for i in range(0, len(payload), c.frame)]
    head = _element(EBML, _element(DOC_TYPE, b"matroska"))
    info = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / c.rate)) + _element(MUXING_APP, b"tidemark") + _element(WRITING_APP, b"tidemark"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", float(c.rate))) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, 1) + _number(DEFAULT_DURATION, ms * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    span = c.frames_per_block * c.blocks_per_cluster
    for first in range(0, len(frames), span):
        base = first * ms
        blocks = []
        for k in range(first, min(first + span, len(frames)), c.frames_per_block):
            own = frames[k : min(k + c.frames_per_block, first + span)]
            even = len({len(f) for f in own}) == 1
            kind = NO_LACING if len(own) == 1 else FIXED if even else EBML_LACING if k // c.frames_per_block % 2 else XIPH
            blocks.append(_element(SIMPLE_BLOCK, write_vint(1) + struct.pack(">hB", k * ms - base, 0x80 | kind << 1) + _lace(own, kind)))
        cluster = _element(CLUSTER, _number(TIMESTAMP, base) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def demux(raw: bytes, track: int | None = None) -> bytes:
    media, view = parse(raw), memoryview(raw)
    return b"".join(view[p.start : p.start + p.length] for p in media.packets if track is None or p.track == track)


# -- DataFrames ----------------------------------------------------------------------------------------------------

PACKETS = "packet long, track int, codec string, timestamp_ns long, keyframe boolean, lacing int, cluster_at long, byte_start long, byte_length long, cued boolean, error string"


def packet_table(files: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet of the Matroska files in a binary column, with the key's column.

    A null file gives no row; a file that can't be parsed gives one row with the error and nulls. Files are parsed one
    by one inside their partition; repeated keys are kept apart only by their rows.
    """
    kind = files.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split()[0] for x in PACKETS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            for i, raw in enumerate(batch.column(1)):
                if not raw.is_valid:
                    continue
                try:
                    m = parse(raw.as_py())
                    codec, cued = {t["number"]: t["codec"] for t in m.tracks}, {(t, p) for _, t, p in m.cues}
                    rows = [(k, p.track, codec.get(p.track), p.timestamp_ns, p.keyframe, p.lacing, p.cluster_at, p.start, p.length, (p.track, p.cluster_at) in cued, None) for k, p in enumerate(m.packets)]
                except (MatroskaError, struct.error, IndexError) as e:
                    rows = [(*[None] * 10, str(e))]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(part), batch.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True))], names=[key, *fields])

    return files.select(key, media).mapInArrow(run, f"{key} {kind.simpleString()}, {PACKETS}")


def text_payload(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % unit or (0 if raw else unit))


def store_texts(docs: DataFrame, config: MuxConfig = MuxConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, padded with bytes 0, as the samples of a Matroska file. Null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                done = [text_payload(t, config.unit) for t in batch.column(1).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array([n for n, _ in done], pa.int64()), pa.array([mux(p, config) for _, p in done], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(stored: DataFrame) -> DataFrame:
    """Digest columns of (doc_id, n_bytes, media), from the payload as the file's packets give it back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                m, view = parse(raw), memoryview(raw)
                payload = b"".join(view[p.start : p.start + p.length] for p in m.packets)
                last = m.packets[-1]
                feature = f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};laced={sum(p.lacing > 0 for p in m.packets)};last_ms={last.timestamp_ns // 1_000_000};codec={m.tracks[0]['codec']};mean={sum(payload) / len(payload):.6f}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, in any partitioning; repeated and null ids are kept, an empty table gives an empty result."""
    return media_digests(store_texts(table(spark, sf_dir, "documents")))
