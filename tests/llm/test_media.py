import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from docframe.llm import media as m


def bits_of(blocks, parts, tables):
    """Entropy-coded data of (component, dc, {position: value}) blocks."""
    out, pred = "", [0] * parts
    for part, dc, ac in blocks:
        codes = [m._codes(*tables[kind, min(part, 1)]) for kind in (0, 1)]

        def put(value, size):
            return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

        d = dc - pred[part]
        pred[part] = dc
        code, n = codes[0][abs(d).bit_length()]
        out += format(code, f"0{n}b") + put(d, abs(d).bit_length())
        run = 0
        for k in range(1, 64):
            v = ac.get(k, 0)
            if not v:
                run += 1
                continue
            while run > 15:
                code, n = codes[1][0xF0]
                out += format(code, f"0{n}b")
                run -= 16
            code, n = codes[1][run << 4 | abs(v).bit_length()]
            out += format(code, f"0{n}b") + put(v, abs(v).bit_length())
            run = 0
        if run:
            code, n = codes[1][0]
            out += format(code, f"0{n}b")
    out += "1" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\0")


def colour_frame(rng, restart):
    """A 4:2:0 frame of 40 x 24 with AC terms and the tables that AVI leaves out; its luma DC image."""
    quant, want = 4, np.zeros((4, 6), int)
    head = b"\xff\xd8" + m._segment(0xDB, bytes([0, *[quant] * 64])) + m._segment(0xC0, struct.pack(">BHHB", 8, 24, 40, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    if restart:
        head += m._segment(0xDD, struct.pack(">H", restart))
    head += m._segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    runs, units = [], [(y, x) for y in range(2) for x in range(3)]
    for at in range(0, 6, restart or 6):
        blocks = []
        for y, x in units[at : at + (restart or 6)]:
            for part in (0, 0, 0, 0, 1, 2):
                ac = {rng.randint(1, 63): rng.choice([-300, -3, 1, 2, 40]) for _ in range(rng.randint(0, 5))}
                dc = rng.randint(-250, 250)
                if part == 0:
                    n = len([b for b in blocks if b[0] == 0]) % 4
                    want[2 * y + n // 2, 2 * x + n % 2] = min(255, max(0, (dc * quant + 4 >> 3) + 128))
                blocks.append((part, dc, ac))
        runs.append(bits_of(blocks, 3, m._STANDARD))
    data = b"".join(r + (b"" if i + 1 == len(runs) else bytes([0xFF, 0xD0 + i])) for i, r in enumerate(runs))
    return head + data + b"\xff\xd9", want


@pytest.mark.parametrize("restart", [0, 2, 4])
def test_decodes_colour_frames(restart):
    rng = random.Random(restart)
    made = [colour_frame(rng, restart) for _ in range(9)]
    for got, (_, want) in zip(m.decode([x for x, _ in made]), made, strict=True):
        assert (got == want).all()


def test_round_trip_and_index():
    rng = random.Random(5)
    payloads = [m.padded(bytes(rng.choice(pool) for _ in range(n))) for n in (0, 1, 575, 576, 577, 4000) for pool in (range(256), b"ab", b"\xff\0")]
    for payload, avi in zip(payloads, m.store(payloads), strict=True):
        whole = m.parse_avi(avi)
        assert whole.fps == m.FPS
        assert b"".join(x.tobytes() for x in m.decode(whole.frames)) == payload
        bare = m.parse_avi(avi[: avi.rindex(b"idx1")])  # without the index
        assert bare.frames == whole.frames
    with pytest.raises(ValueError):
        m.parse_avi(b"RIFF....WAVE")


def test_features_and_clips(spark):
    rows = [(1, "a" * 576 * 20 + "éZ" * 5000), (2, ""), (3, None), (4, "x y\n" * 300), (5, "x y\n" * 300), (None, "q")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows] + [(4, "x y\n" * 300, "", 2)], "doc_id long, text string, media string, n_bytes int")
    got = m.media_features(docs).collect()
    assert len(got) == 7
    for r in got:
        text = (dict(rows)[r.doc_id] or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 or 576 * (not text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        avi = m.store([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(avi), hashlib.sha256(avi).hexdigest())
    assert len({r.feature for r in got if r.doc_id in (4, 5)}) == 1
    shots = [tuple(x)[1:] for x in m.clips(m.to_media(docs)).where("doc_id = 1").orderBy("clip").collect()]
    assert shots[0] == (0, 0, 20, 0.0, 0.8) and len(shots) >= 2
    assert m.media_features(docs.limit(0)).count() == 0


def plain_cuts(frames):
    """cuts_of for one video, frame by frame."""
    hists = []
    for f in frames:
        h = [0] * m.HIST_BINS
        for v in f.ravel().tolist():
            h[v * m.HIST_BINS >> 8] += 1
        hists.append(h)
    share = [[x / sum(h) for x in h] for h in hists]
    gap = [0.0] + [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(share, share[1:], strict=False)]
    first = []
    for i in range(len(frames)):
        near = [gap[j] for j in range(max(1, i - m.WINDOW), min(len(frames), i + m.WINDOW + 1)) if j != i]
        mean = sum(near) / max(1, len(near))
        spread = max(0.0, sum(x * x for x in near) / max(1, len(near)) - mean**2) ** 0.5
        first.append(i == 0 or (len(near) > 0 and gap[i] > m.FLOOR and gap[i] > round(mean + m.SIGMAS * spread, 9)))
    return first, [sum(h[b] for h in hists) for b in range(m.HIST_BINS)]


def test_features_equal_plain_python(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(pool) * rng.randint(1, 900) for pool in ("ab", "XYZ", "é", "0 1\n") for _ in range(rng.randint(0, 4))) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in m.media_features(docs).collect():
        frames = [np.frombuffer(x, np.uint8) for x in [m.padded(texts[r.doc_id].encode())[i : i + m.FRAME] for i in range(0, r.payload_bytes, m.FRAME)]]
        first, hist = plain_cuts(frames)
        marks = [*(i for i, x in enumerate(first) if x), len(frames)]
        spans = ",".join(f"{a / m.FPS:.2f}-{b / m.FPS:.2f}" for a, b in zip(marks, marks[1:], strict=False))
        assert r.feature == f"frames={len(frames)};clips={spans};hist={','.join(map(str, hist))}"


def test_broken_media(spark):
    good = m.store([m.padded(b"a" * 3456)])[0]
    frame = m.parse_avi(good).frames[2]
    torn = good.replace(frame, b"\0" * len(frame), 1)  # the first of equal frames
    rows = [(1, good), (2, b"no media"), (3, good[: len(good) // 2]), (4, torn), (5, None), (6, b""), (7, b"RIFF\0\0"), (8, b"RIFF\xff\0\0\0AVI LIST")]
    media = spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "1 as clip")
    got = m.clips(media).collect()
    spans = {d: [(r.clip, r[2], r[3]) for r in got if r.doc_id == d] for d, _ in rows}
    assert spans[1] == spans[4] == [(0, 0, 6)] and spans[2] == spans[5] == spans[6] == spans[7] == spans[8] == []
