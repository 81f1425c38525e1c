"""Motion JPEG in AVI: writing, RIFF index parsing, intra decoding at one sample a block, shots.

``store`` keeps any bytes as a video: 576 bytes are one frame of 24 x 24 samples, each sample
an 8 x 8 block of one grey, which baseline JPEG holds exactly in the block's DC term (step 8).
``decode`` reads any AVI of baseline or extended Huffman JPEG frames back as DC images, one sample
a block, the usual input of shot detection. Frames with equal headers are decoded in
lockstep: every step decodes the next symbol of all of them with array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, inputs, slices, texts_of

SIDE, FRAME, FPS = 24, 576, 25
#: DC categories by code length (JPEG's BITS and HUFFVAL): differences of text bytes mostly have 4 to 7 bits.
DC_BITS, DC_VALUES = (0, 1, 3, 5), (6, 4, 5, 7, 0, 1, 2, 3, 8)
HIST_BINS, WINDOW, SIGMAS, FLOOR = 16, 8, 2.5, 0.25

FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "doc_id long, clip int, start_frame long, end_frame long, start_s double, end_s double"


def _codes(bits: tuple, values: tuple) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), canonical."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, bits: tuple, values: tuple) -> bytes:
    return _segment(0xC4, bytes([kind, *bits, *[0] * (16 - len(bits)), *values]))


_HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, *[8] * 64]))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _table(0x00, DC_BITS, DC_VALUES)
    + _table(0x10, (1,), (0,))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _code_book() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of DC difference d (at d + 255) with the end-of-block code that follows."""
    codes, value, length = _codes(DC_BITS, DC_VALUES), np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return value, length


_VALUE, _LENGTH = _code_book()


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or FRAME * (not text))


def _scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of frames (n, 576) of 8-bit samples, byte stuffing included."""
    step = np.diff(samples.astype(np.int64), axis=1, prepend=128) + 255
    value, length = _VALUE[step], _LENGTH[step]
    ends = np.cumsum(length, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = (first[:-1, None] * 8 + ends - length).ravel()
    window = value.ravel() << (32 - (at & 15) - length.ravel())
    words = int(first[-1] * 8 >> 4) + 2
    packed = np.bincount(at >> 4, window >> 16, words) + np.bincount((at >> 4) + 1, window & 0xFFFF, words)
    data = packed.astype(">u2").view(np.uint8)[: first[-1]].copy()
    data[first[1:] - 1] |= ((1 << (sizes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    stuff = np.flatnonzero(data == 0xFF)
    first = first + np.searchsorted(stuff, first)
    raw = np.insert(data, stuff + 1, 0).tobytes()
    cuts = first.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _avi(frames: list[bytes], width: int, height: int, fps: int) -> bytes:
    chunks, index, at = [], [], 4
    for x in frames:
        pad = b"\0" * (len(x) & 1)
        chunks += [struct.pack("<4sI", b"00dc", len(x)), x, pad]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += 8 + len(x) + len(pad)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    listed = lambda kind, body: struct.pack("<4sI4s", b"LIST", len(body) + 4, kind) + body
    chunk = lambda kind, body: struct.pack("<4sI", kind, len(body)) + body
    hdrl = listed(b"hdrl", chunk(b"avih", avih) + listed(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    body = b"AVI " + hdrl + listed(b"movi", b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload, whose length is a positive multiple of 576."""
    scans = _scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    out, at = [], 0
    for x in payloads:
        n = len(x) // FRAME
        out.append(_avi([_HEADER + s + b"\xff\xd9" for s in scans[at : at + n]], SIDE * 8, SIDE * 8, FPS))
        at += n
    return out


@dataclass
class Video:
    fps: float = float(FPS)
    frames: list[bytes] = field(default_factory=list)


def parse_avi(data: bytes) -> Video:
    """Frames of the first video stream by the idx1 index, or by walking movi where there is none.
    Raises ValueError for what isn't AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    video, movi, index, streams = Video(), (0, 0), b"", []
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, min(end, at + 8 + size))
                else:
                    todo.append((at + 12, min(end, at + 8 + size)))
            elif kind == b"strh":
                streams.append((data[at + 8 : at + 12], *struct.unpack_from("<II", data, at + 28)))
            elif kind == b"idx1":
                index = data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    number = next((i for i, s in enumerate(streams) if s[0] == b"vids"), 0)
    if number < len(streams) and streams[number][1]:
        video.fps = streams[number][2] / streams[number][1]
    wanted = {b"%02ddc" % number, b"%02ddb" % number}
    if index:
        base = None
        for kind, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
            if kind in wanted:
                if base is None:  # offsets count from the list's kind or from the file's start
                    base = movi[0] if data[movi[0] + offset : movi[0] + offset + 4] == kind else 0
                video.frames.append(data[base + offset + 8 : base + offset + 8 + size])
    else:
        at, end = movi[0] + 4, movi[1]
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                at += 12
                continue
            if kind in wanted:
                video.frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return video


def _standard_tables() -> dict[tuple[int, int], tuple[tuple, tuple]]:
    """The typical tables of the JPEG standard (annex K), which AVI frames may leave out."""
    dense = lambda lows: [x << 4 | y for x, low in enumerate(lows) for y in range(low, 11)]
    light = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a")
    colour = bytes.fromhex("0001020311040521310612415107617113223281081442" "91a1b1c109233352f0156272d10a162434e125f1")
    rest = lambda head: [*head, *(x for x in dense([1] * 16) if x not in head)]
    return {
        (0, 0): ((0, 1, 5, 1, 1, 1, 1, 1, 1), tuple(range(12))),
        (0, 1): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1), tuple(range(12))),
        (1, 0): ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), tuple(rest(light))),
        (1, 1): ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), tuple(rest(colour))),
    }


_STANDARD = _standard_tables()


def _lookup(bits: tuple, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits that may come next; length 0 for no code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for value, (code, n) in _codes(bits, values).items():
        symbol[code << 16 - n : code + 1 << 16 - n] = value
        length[code << 16 - n : code + 1 << 16 - n] = n
    return symbol, length


def _fused(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits: the DC difference and total length of DC code, its bits and an
    end of block, where all fit into them; length 0 otherwise."""
    ahead = np.arange(1 << 16)
    size, n = dc[0], dc[1]
    room = (n > 0) & (n + size <= 16)
    raw = (ahead >> np.where(room, 16 - n - size, 0)) & ((1 << np.minimum(size, 16)) - 1)
    diff = np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << np.minimum(size, 16)) + 1, raw) * (size > 0)
    used = np.where(room, n + size, 0)
    rest = (ahead << used) & 0xFFFF
    end = (ac[1][rest] > 0) & (ac[0][rest] == 0)
    total = used + ac[1][rest]
    return np.where(room & end & (total <= 16), diff, 0), np.where(room & end & (total <= 16), total, 0)


@lru_cache(16)
def _head(head: bytes) -> dict:
    """What a frame's segments, up to its scan, say."""
    quant, tables, out, at = {}, dict(_STANDARD), {"restart": 0}, 2
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                quant[n] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit JPEG frames are decoded")
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            out |= {"size": (height, width), "parts": parts}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:#x} is not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            single = len(scan) == 1
            plan = []
            for i, (name, sel) in enumerate(scan):
                h, v, q = out["parts"][name]
                dc, ac = (_lookup(*tables[0, sel >> 4])), (_lookup(*tables[1, sel & 15]))
                plan += [(i, dc, ac, _fused(dc, ac), quant[q])] * (1 if single else h * v)
            most = [max(p[i] for p in out["parts"].values()) for i in (0, 1)]
            if single:
                most = [1, 1]
            across, down = -(-out["size"][1] // (8 * most[0])), -(-out["size"][0] // (8 * most[1]))
            h, v = (1, 1) if single else out["parts"][scan[0][0]][:2]
            out |= {"plan": plan, "across": across, "down": down, "first": (h, v)}
    return out


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """A frame's segments up to its first scan, and the coded data that follows."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + (frame[at + 2] << 8 | frame[at + 3])
    at += 2 + (frame[at + 2] << 8 | frame[at + 3])
    return frame[:at], frame[at : frame.rfind(b"\xff\xd9")] if frame.endswith(b"\xff\xd9") else frame[at:]


def _runs(data: bytes) -> list[bytes]:
    """Coded data at each restart marker; a marker can't occur inside because of stuffing."""
    out, start, at = [], 0, data.find(b"\xff")
    while at >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[start:]]


def _lockstep(head: dict, scans: list[bytes]) -> np.ndarray:
    """DC images (n, rows, columns) of the first component of frames with one header."""
    plan, across, down, (h, v) = head["plan"], head["across"], head["down"], head["first"]
    units, every = across * down, head["restart"] or across * down
    pieces = [r for s in scans for r in _runs(s)] if head["restart"] else scans
    each = -(-units // every)
    if len(pieces) != each * len(scans):
        raise ValueError("restart markers are missing")
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = ~((data[1:] == 0) & (data[:-1] == 0xFF))
    keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    ends = np.cumsum(sizes)
    pos = np.concatenate([[0], np.cumsum(keep)])[ends - sizes] * 8
    clean = np.concatenate([data[keep], np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    ahead = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    last = len(ahead) - 1

    def peek(p: np.ndarray) -> np.ndarray:
        return (ahead[np.minimum(p >> 3, last)] >> (16 - (p & 7))) & 0xFFFF

    firsts = sum(x[0] == 0 for x in plan)
    out = np.zeros((min(every, units) * firsts, len(pieces)), np.int64)
    pred, slot = [np.zeros(len(pieces), np.int64) for _ in plan], 0
    for _ in range(min(every, units)):  # the last run of a frame may have fewer units; what it yields beyond is cut off
        for part, dc, ac, (fused, length), q in plan:
            bits = peek(pos)
            diff, n = fused[bits], length[bits]
            pos = pos + n
            if not n.all():
                slow = np.flatnonzero(n == 0)
                size, n = dc[0][bits[slow]], dc[1][bits[slow]]
                p = pos[slow] + n
                raw = peek(p) >> (16 - size)
                diff[slow] = np.where(raw < (1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw) * (size > 0)
                p += size
                k, live = np.zeros(len(slow), np.int64), np.arange(len(slow))
                while len(live):
                    bits = peek(p[live])
                    symbol, n = ac[0][bits], ac[1][bits]
                    p[live] += np.maximum(n, 1) + (symbol & 15)
                    k[live] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                    live = live[k[live] < 63]
                pos[slow] = p
            pred[part] += diff
            if part == 0:
                np.clip((pred[part] * q + 4 >> 3) + 128, 0, 255, out=out[slot])
                slot += 1
    flat = out.T.reshape(len(scans), each * min(every, units) * firsts)[:, : units * firsts]
    return flat.reshape(len(scans), down, across, v, h).transpose(0, 1, 3, 2, 4).reshape(len(scans), down * v, across * h).astype(np.uint8)


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """The DC image of every frame, in order."""
    by: dict[bytes, list[int]] = {}
    scans = []
    for i, x in enumerate(frames):
        head, scan = _split(x)
        by.setdefault(head, []).append(i)
        scans.append(scan)
    out: list = [None] * len(frames)
    for head, at in by.items():
        for i, image in zip(at, _lockstep(_head(head), [scans[i] for i in at]), strict=True):
            out[i] = image
    return out


def cuts_of(frames: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which frames start a shot, for videos of ``counts`` frames one after another; and the
    frames' histograms. A frame does if the distance of its histogram to the one before it
    exceeds FLOOR and the mean of the WINDOW distances on either side by SIGMAS deviations."""
    sizes = np.fromiter((f.size for f in frames), np.int64, len(frames))
    values = np.concatenate([f.ravel() for f in frames]).astype(np.int64) * HIST_BINS >> 8
    hist = np.bincount(np.repeat(np.arange(len(frames)) * HIST_BINS, sizes) + values, minlength=len(frames) * HIST_BINS).reshape(-1, HIST_BINS)
    share = hist / sizes[:, None]
    start = np.repeat(np.cumsum(counts) - counts, counts)
    stop = start + np.repeat(counts, counts)
    at = np.arange(len(frames))
    gap = np.zeros(len(frames))
    gap[1:] = np.abs(share[1:] - share[:-1]).sum(1) / 2
    gap[at == start] = 0
    one, two = (np.concatenate([[0], np.cumsum(gap**k)]) for k in (1, 2))
    lo, hi = np.maximum(at - WINDOW, start + 1), np.minimum(at + WINDOW + 1, stop)
    n = np.maximum(hi - lo - 1, 1)
    mean = (one[np.maximum(hi, lo)] - one[lo] - gap) / n
    spread = np.sqrt(np.maximum((two[np.maximum(hi, lo)] - two[lo] - gap**2) / n - mean**2, 0))
    return (at == start) | ((gap > FLOOR) & (gap > np.round(mean + SIGMAS * spread, 9)) & (hi - lo > 1)), hist


def _videos(media: list[bytes]) -> tuple[list[Video], list[np.ndarray], np.ndarray]:
    videos = [parse_avi(x) for x in media]
    return videos, decode([f for v in videos for f in v.frames]), np.array([len(v.frames) for v in videos], np.int64)


#: What broken files and frames raise.
BROKEN = (ValueError, IndexError, KeyError, OverflowError, struct.error)


def _shown(frames: list[bytes]) -> list[np.ndarray]:
    """The DC images of one video's frames. As in players, a frame that is empty or broken shows the one before it (the first
    sound one, at the start); no sound frame gives none."""
    out: list[np.ndarray | None] = []
    for x in frames:
        try:
            out.append(decode([x])[0])
        except BROKEN:
            out.append(out[-1] if out else None)
    sound = next((x for x in out if x is not None), None)
    return [] if sound is None else [sound if x is None else x for x in out]


def _any_videos(media: list[bytes]) -> tuple[list[Video], list[np.ndarray], np.ndarray]:
    """:func:`_videos` of files that may be broken, together if all are sound, else one at a time; what isn't AVI has no frames."""
    try:
        return _videos(media)
    except BROKEN:
        pass
    videos, images = [], []
    for x in media:
        try:
            videos.append(parse_avi(x))
        except BROKEN:
            videos.append(Video())
        images.append(_shown(videos[-1].frames))
    return videos, [f for fs in images for f in fs], np.array([len(fs) for fs in images], np.int64)


def clips(media: DataFrame) -> DataFrame:
    """CLIPS for every row of ``media`` (doc_id, media binary): shots with their times. A null
    media, what isn't AVI and a video without a sound frame have no rows; a broken frame shows the one before it. Repeated
    rows have rows each, null ids stay, an empty table has no rows, and other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("media").is_valid())
            for part in slices(batch, "media"):
                videos, frames, counts = _any_videos(texts_of(part, "media"))
                first = cuts_of(frames, counts)[0] if frames else np.zeros(0, bool)
                rows, at = [], 0
                for doc, video, n in zip(part.column("doc_id").to_pylist(), videos, counts.tolist(), strict=True):
                    marks = [*np.flatnonzero(first[at : at + n]).tolist(), n]
                    rows += [(doc, i, a, b, a / video.fps, b / video.fps) for i, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
                    at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in CLIPS.split(", ")])

    return arrow_map(inputs(media, doc_id="long", media="binary"), run, CLIPS)


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text's UTF-8 bytes, filled up with 255, as an AVI. Null and empty texts are one frame of
    255s, null ids stay, repeated rows have a row each, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(store([padded(x) for x in texts_of(part)]), pa.binary())], ["doc_id", "media"])

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, "doc_id long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """FEATURES per row of ``docs`` (doc_id, text): each text is stored as a video, and all
    but ``n_bytes`` is computed from the stored bytes. A null text counts as empty, an empty
    text as one frame of 255s; a null doc_id stays. Equal texts have equal values, repeated
    rows a row each, and an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                media = store([padded(x) for x in texts])
                _, frames, counts = _videos(media)
                first, hist = cuts_of(frames, counts)
                whole = np.concatenate([f.ravel() for f in frames]).tobytes()
                sizes = np.fromiter((f.size for f in frames), np.int64, len(frames))
                ends = np.cumsum(counts)
                total = np.concatenate([[0], np.cumsum(sizes)])
                hists = np.add.reduceat(hist, ends - counts, axis=0)
                rows = []
                for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    payload = whole[total[end - n] : total[end]]
                    marks = [*np.flatnonzero(first[end - n : end]).tolist(), n]
                    spans = ",".join(f"{a / FPS:.2f}-{b / FPS:.2f}" for a, b in zip(marks, marks[1:], strict=False))
                    feature = f"frames={n};clips={spans};hist={','.join(map(str, hists[i].tolist()))}"
                    rows.append((len(texts[i]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], [x.split()[0] for x in FEATURES.split(", ")])

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, FEATURES)
