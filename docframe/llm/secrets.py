"""Secret scanning through nested encodings.

Each text starts a worklist of layers. A layer is scanned for secrets, then every encoding found
in it gives a new layer: percent and backslash escapes are resolved over the whole
layer with a position for each character; a base64 or hexadecimal run is decoded and, as a
known compressed stream, inflated, all members of it; whatever bytes come out are scanned, large layers in windows. Lines of a wrapped run
are decoded one by one and joined. A layer whose content was seen before in
the same place is not entered again, so the list reaches a fixpoint. Spans of inner layers are mapped to the
code points of the original text that encode them.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import itertools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, inputs, numbered, place, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
#: Parts of a lower-cased text without one of which it has no assignment.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEXRUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){8,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){8,}(?![0-9A-Za-z])")
#: What parts the lines of a wrapped run, its last line if that is short, and what a whole line must not go on with.
WRAP = re.compile(r"[ \t]*(?:\r\n?|\n)[ \t]*")
LAST = re.compile(r"[ \t]*(?:\r\n?|\n)[ \t]*[A-Za-z0-9+/_-]{1,15}={0,2}(?![A-Za-z0-9+/_=-])")
MORE = re.compile(r"[ \t]+[^\s]")
#: Bytes that are inflated at once, and after which a layer is scanned in windows. A window ends at a byte that no pattern goes
#: across; if its last TAIL bytes have none, the next window repeats them.
CHUNK, WINDOW, TAIL = 1 << 20, 64 << 20, 32 << 20
BREAK = re.compile(rb"(?s).*(?:[^A-Za-z0-9+/_.=%\\{}:\"'\s\x00-]|[A-Za-z0-9] (?=[A-Za-z0-9]))")

SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, via: string, value: string>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer as (kind, start, end): leftmost, not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def stream_kind(head: bytes) -> str | None:
    """The name of a known compressed stream that starts so."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 6 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    return "bz2" if head[:3] == b"BZh" else None


class _Source(io.RawIOBase):
    """Chunks as a file."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        self.rest = self.rest or next(self.chunks, b"")
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def inflate(kind: str, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a compressed stream in chunks of bounded size, all its members or frames one after another; it
    ends where the stream is damaged."""
    source = io.BufferedReader(_Source(chunks), CHUNK)
    try:
        if kind == "zstd":
            reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
            while out := reader.read(CHUNK):
                yield out
            return
        data = source.read1(CHUNK)
        while stream_kind(data + source.peek(8)[:8]) == kind:
            if kind == "bz2":
                member = bz2.BZ2Decompressor()
                while not member.eof:
                    if member.needs_input and not data and not (data := source.read1(CHUNK)):
                        return
                    out, data = member.decompress(data, CHUNK), b""
                    if out:
                        yield out
            else:
                member = zlib.decompressobj(31 if kind == "gzip" else 15)
                while not member.eof:
                    if not data and not (data := source.read1(CHUNK)):
                        yield member.flush()
                        return
                    out, data = member.decompress(data, CHUNK), member.unconsumed_tail
                    if out:
                        yield out
            data = member.unused_data
            while not (data := data.lstrip(b"\0") if kind == "gzip" else data):  # members may be padded
                if not (data := source.read1(CHUNK)):
                    return
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, ValueError):
        pass


def windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All bytes of ``chunks`` in windows of about WINDOW bytes, so that no match of less than TAIL bytes is lost."""
    have, fresh = bytearray(), False
    for chunk in chunks:
        have += chunk
        fresh = True
        if len(have) >= WINDOW:
            near, far = bytes(have[-4096:]), bytes(have[-TAIL:])
            tail = near if BREAK.match(near) else far
            if cut := BREAK.match(tail):
                at = len(have) - len(tail) + cut.end()
                yield bytes(have[:at])
                del have[:at]
                fresh = bool(have)
            else:
                yield bytes(have)
                have, fresh = bytearray(far), False
    if fresh:
        yield bytes(have)


def _views(data: bytes) -> list[str]:
    """Decoded bytes as text: as UTF-8 in which invalid bytes stay as surrogates, by their byte order mark if any, and of
    bytes with NULs as UTF-16 if they are that, or as what is left without the NULs; patterns are ASCII only."""
    out = [data.decode("utf-8", "surrogateescape")]
    if data[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        out.append(data.decode("utf-32", "replace"))
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        out.append(data.decode("utf-16", "replace"))
    nulls = data.count(0)
    if nulls:
        if 8 * nulls >= len(data) and len(data) % 2 == 0:
            try:
                return [*out, data.decode("utf-16-le" if 2 * data[1::2].count(0) >= nulls else "utf-16-be")]
            except UnicodeDecodeError:
                pass
        out.append(data.replace(b"\0", b"").decode("utf-8", "surrogateescape"))
    return [x for x in out if x]


def _unwrap(data: bytes, via: str) -> Iterator[tuple[str, str, bool]]:
    """The texts in decoded bytes, inflated as often as needed, as (via, text, whether that is all of its layer rather
    than a window)."""
    head, chunks, seen = data, iter([data]), set()
    while (kind := stream_kind(head)) and head not in seen:
        seen.add(head)
        inner, got = inflate(kind, chunks), b""
        while len(got) < CHUNK and (more := next(inner, b"")):
            got += more
        if not got:  # no such stream after all
            chunks = iter([head])
            break
        head, chunks, via = got, itertools.chain([got], inner), f"{via}>{kind}"
    before, whole = None, True
    for window in windows(chunks):
        if before is not None:
            whole = False
            yield from ((via, text, False) for text in _views(before))
        before = window
    if before is not None:
        yield from ((via, text, whole) for text in _views(before))


def _runs(content: str, pattern: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Every match as (run, start, end), and matches that are lines of one wrapped run joined as well."""
    group: list[re.Match] = []

    def joined() -> Iterator[tuple[str, int, int]]:
        if group:
            last = None if group[-1].group().endswith("=") else LAST.match(content, group[-1].end())
            if last and MORE.match(content, last.end()):
                last = None
            if last or len(group) > 1:
                end = last.end() if last else group[-1].end()
                yield WRAP.sub("", content[group[0].start() : end]), group[0].start(), end

    for m in pattern.finditer(content):
        if not _wordy(m.group()):
            yield m.group(), m.start(), m.end()
        if group and (group[-1].group().endswith("=") or not WRAP.fullmatch(content, group[-1].end(), m.start()) or MORE.match(content, m.end())):
            yield from joined()
            group = []
        group.append(m)
    yield from joined()


def _escapes(text: str, pattern: re.Pattern, resolve) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with all matches resolved, and for every character of it the start and end
    in ``text`` of what stands for it; None if nothing could be resolved."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        got = resolve(m.group())
        if got is None:
            continue
        plain = np.arange(at, m.start())
        parts += [text[at : m.start()], "".join(c for c, _ in got)]
        widths = np.cumsum([0, *(w for _, w in got)]) + m.start()
        starts += [plain, widths[:-1]]
        ends += [plain + 1, widths[1:]]
        at = m.end()
    if not parts:
        return None
    plain = np.arange(at, len(text))
    return "".join([*parts, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _bytes(data: bytes, width: int) -> list[tuple[str, int]]:
    """Characters of escaped UTF-8 and how long their escapes are; an invalid byte is a character of its own."""
    return [(c, width * len(c.encode("utf-8", "surrogateescape"))) for c in data.decode("utf-8", "surrogateescape")]


def _url(run: str) -> list[tuple[str, int]]:
    return _bytes(bytes.fromhex(run.replace("%", "")), 3)


def _unicode(run: str) -> list[tuple[str, int]] | None:
    try:
        if run[:3] == "\\u{" or run[1] == "U":
            return [(chr(int(run[2:].strip("{}"), 16)), len(run))]
    except (ValueError, OverflowError):  # no code point
        return None
    if run[1] == "x":
        return _bytes(bytes.fromhex(run.replace("\\x", "")), 4)
    return [(c, 6 * (1 + (ord(c) > 0xFFFF))) for c in bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")]


def _base64(run: str) -> bytes | None:
    core = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:  # a character that is no part of it
        core = core[:-1]
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _hex(run: str) -> bytes | None:
    try:
        return bytes.fromhex(run)
    except ValueError:  # wrapped lines of which the last is something else
        return None


def _wordy(run: str) -> bool:
    """Whether a run is plain letters of at most one case change in front, hence a word rather than code."""
    return run.isalpha() and (run[1:].islower() or run.isupper())


def _layer(content: str) -> tuple[list, list, list]:
    """What one layer holds, in its own positions: secrets, escape layers as (name, text, starts, ends), and
    decoded runs as (name, bytes, start, end)."""
    escaped = []
    for name, mark, pattern, resolve in (("url", "%", URL, _url), ("unicode", "\\", UNICODE, _unicode)):
        if mark in content and (got := _escapes(content, pattern, resolve)):
            escaped.append((name, *got))
    decoded = []
    for name, pattern, decode in (("base64", BASE64, _base64), ("hex", HEXRUN, _hex)):
        decoded += [(name, data, start, end) for run, start, end in _runs(content, pattern) if (data := decode(run))]
    return base_spans(content), escaped, decoded


def scan(text: str) -> list[tuple[str, int, int, str, str]]:
    """All secrets as (kind, start, end, via, value), via being "" for the text itself and
    otherwise the layers down to it; a value of equal kind and place counts once, the
    outermost. A run that stands in several places has its secrets in each of them. Ordered
    by start, kind, end."""
    found: dict[tuple[str, int, int, str], str] = {}
    known: dict[str, tuple[list, list, list]] = {}
    texts: dict[tuple[str, bytes], list[tuple[str, str, bool]]] = {}
    seen = set()

    def fresh(content: str, place) -> bool:
        spot = place if place is None or isinstance(place[0], int) else (place[0].tobytes(), place[1].tobytes())
        key = content if len(content) < CHUNK else hashlib.sha256(content.encode("utf-8", "surrogatepass")).digest(), spot
        new = key not in seen
        seen.add(key)
        return new

    def unwrapped(name: str, data: bytes) -> Iterator[tuple[str, str, bool]]:
        if (name, data) in texts:
            yield from texts[name, data]
            return
        kept, size = [], 0
        for layer in _unwrap(data, name):
            size += len(layer[1])
            kept = [*kept, layer] if size < CHUNK else []
            yield layer
        if size < CHUNK:
            texts[name, data] = kept

    def walk(via: str, content: str, place) -> None:
        layers = deque([(via, content, place)])
        while layers:
            via, content, place = layers.popleft()
            got = known.get(content) if len(content) < CHUNK else None
            if got is None:
                got = _layer(content)
                if len(content) < CHUNK:
                    known[content] = got
            spans, escaped, decoded = got

            def outer(start: int, end: int, place=place) -> tuple[int, int]:
                if place is None:
                    return start, end
                return (place[0], place[1]) if isinstance(place[0], int) else (int(place[0][start]), int(place[1][end - 1]))

            for kind, start, end in spans:
                found.setdefault((kind, *outer(start, end), content[start:end]), via)
            for name, inner, starts, ends in escaped:
                if place is not None and isinstance(place[0], int):
                    spot = place
                else:
                    spot = (starts, ends) if place is None else (place[0][starts], place[1][ends - 1])
                if fresh(inner, spot):
                    layers.append((f"{via}>{name}".lstrip(">"), inner, spot))
            for name, data, start, end in decoded:
                spot = outer(start, end)
                for v, inner, whole in unwrapped(name, data):
                    if not fresh(inner, spot):
                        continue
                    if whole:
                        layers.append((f"{via}>{v}".lstrip(">"), inner, spot))
                    else:  # one window at a time
                        walk(f"{via}>{v}".lstrip(">"), inner, spot)

    fresh(text, None)
    walk("", text, None)
    order = sorted(found, key=lambda k: (k[1], KINDS.index(k[0]), k[2]))
    return [(*k[:3], found[k], k[3]) for k in order]


def secret_spans(docs: DataFrame) -> DataFrame:
    """SPANS per row of ``docs`` (doc_id, text): the secrets of the whole text and of what is encoded
    in it, as :func:`scan` gives them. A null or empty text has an empty list, a null doc_id
    stays, repeated rows get a row each, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string()), ("value", pa.string())]))
        names = ("kind", "start", "end", "via", "value")
        for batch in batches:
            for part in slices(batch):
                rows = [[dict(zip(names, s, strict=True)) for s in scan(t)] if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, SPANS)


def _places(spans: list[tuple[str, int, int, str, str]]) -> list[tuple[int, int]]:
    """The places of spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for _, start, end, *_ in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the places of all secrets in ``text`` replaced, encoded ones and each repeat included; other columns
    stay, whatever their names. A null text stays null, an empty one empty; repeated rows are treated alike, an
    empty table gives no rows."""
    at = place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                for start, end in reversed(_places(scan(t)) if t else []):
                    t = t[:start] + mark + t[end:]
                out.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    flat = numbered(docs)
    return arrow_map(flat, run, flat.schema).toDF(*docs.columns)


def span_digests(docs: DataFrame) -> DataFrame:
    """Per row: how many secrets of each kind the text itself has, the SHA-256 of their list, and
    the list of all spans, decoded layers included; a place of several values of a kind is listed once. For nulls, empty texts,
    repeats and empty tables see :func:`secret_spans`."""
    as_text = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["via"] == "")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}' and s.via = '')) as long)").alias(f"n_{k}") for k in KINDS]
    return secret_spans(docs).select("doc_id", *counts, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), F.array_join(F.array_distinct(F.split(as_text(F.col("spans")), ",")), ",").alias("spans"))
