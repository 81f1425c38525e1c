import base64
import bz2
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import zstandard

from docframe.llm import secrets as s

KEY = "AKIA" + "ABCDEFGH12345678"
LINE = 'api_key = "zz19x+/Q.2=="'


def brute(text):
    out = []
    for i, (kind, pattern, least) in enumerate(
        (
            ("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
            ("access", r"(AKIA[A-Z0-9]+)", 20),
            ("hex", r"([0-9a-f]+)", 24),
        )
    ):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(1)) >= least]
    return ",".join(x for _, _, x in sorted(out))


def spans(text):
    return [x[:4] for x in s.scan(text)]


def test_base_equals_brute_force():
    rng = random.Random(4)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "API_key", "apikey", " ", "=", ":", '"', "'", "abc", "x1/_-", "AKIA", "AKIAABCDEFGH1234567", "0123456789abcdef" * 2, "é", "\n", "%", "%%%", "deadbeef"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = [x for x in s.scan(text) if x[3] == ""]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in got) == brute(text)


def test_layers_map_to_their_place():
    for wrap, via in (
        (lambda t: base64.b64encode(t.encode()).decode(), "base64"),
        (lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode())).decode(), "base64>gzip"),
        (lambda t: base64.b64encode(zlib.compress(zstandard.compress(t.encode()))).decode().rstrip("="), "base64>zlib>zstd"),
        (lambda t: base64.b64encode(base64.b64encode(t.encode())).decode(), "base64>base64"),
        (lambda t: t.encode().hex().upper(), "hex"),
    ):
        code = wrap(f"é {LINE} and more")
        text = f"ñ before {code} after"
        assert ("assign", 9, 9 + len(code), via) in spans(text)
    inner = urllib.parse.quote(f"é {KEY}").replace("AK", "%41K")
    text = "ñ " + inner + " tail"
    assert spans(text) == [("access", 2 + len("%C3%A9%20"), 2 + len(inner), "url")]
    text = "x " + "".join(f"\\u{ord(c):04x}" for c in LINE)
    got = [x for x in spans(text) if x[0] == "assign"]
    assert got == [("assign", 2, len(text) - 6, "unicode")]
    twice = urllib.parse.quote(urllib.parse.quote("token=secret99"))
    assert spans(twice) == [("assign", 0, len(twice), "url>url")]


def test_cycles_and_bombs_end():
    text = "%2525252541" * 5 + "%" * 50 + "\\u0025\\u0034\\u0031"
    s.scan(text)
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    assert spans(bomb) == [] or all(x[3] for x in spans(bomb))


def test_columns_and_edge_rows(spark):
    rows = [(1, f"{LINE}\n{KEY} " + "ab12" * 8), (2, None), (3, ""), (4, "plain words"), (None, LINE), (1, f"{LINE}\n{KEY} " + "ab12" * 8), (5, base64.b64encode(LINE.encode()).decode())]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, kind string")
    got = s.span_digests(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [len(re.findall(k + ":", want)) for k in s.KINDS]
        if r.doc_id != 5:
            assert r.spans == want
        else:
            assert r.spans == "assign:0:32"
    clean = s.redact(docs).where("doc_id = 1").first()
    assert KEY not in clean.text and clean.kind == "x"
    assert s.span_digests(docs.limit(0)).count() == 0


def test_repeated_runs_and_all_values_of_a_run():
    code = base64.b64encode(b"token=secret99 and password: hunter22x").decode()
    text = f"a {code} b {code} c"
    places = [(2, 2 + len(code)), (5 + len(code), 5 + 2 * len(code))]
    assert [(x[1:3], x[4]) for x in s.scan(text)] == [(p, v) for p in places for v in ("token=secret99", "password: hunter22x")]
    assert s._places(s.scan(text)) == places
    nested = base64.b64encode(code.encode()).decode()
    assert [x[1:3] for x in s.scan(f"{nested} {code} {nested}")][::2] == [(0, len(nested)), (len(nested) + 1, len(nested) + 1 + len(code)), (len(nested) + len(code) + 2, 2 * len(nested) + len(code) + 2)]
    assert s._places(s.scan(f"x token={KEY} y")) == [(2, 8 + len(KEY))]


def test_layers_that_are_not_plain_text():
    line = "token=secret99"
    for data in (
        f"été\u00a0\u202f\u3000\u200b\u00ad\f {line}".encode(),
        f"\ufeff{line}".encode(),
        b"\x00\x01\xff\xfe\x89header " + line.encode() + b"\x00",
        line.encode("utf-16-le"),
        line.encode("utf-16-be"),
        line.encode("utf-16"),
        line.encode("utf-32"),
        b"\xff\xfe\x01" + line.encode(),
        b"\x07" + line.encode("utf-16-le"),
        "密".encode("utf-16-le") + f"é {line}".encode("utf-16-le"),
    ):
        for code, via in ((base64.b64encode(data).decode(), "base64"), (data.hex(), "hex"), (base64.b64encode(gzip.compress(data)).decode(), "base64>gzip")):
            assert ("assign", 2, 2 + len(code), via, line) in s.scan(f"x {code}"), (data, via)
    for text in ("%FF%74oken=secret99 %E9", "%FFtoken%3Dsecret99%E9", "\\xff\\x74oken=secret99", "\\ud800\\u0074oken=secret99", "%74oken=secret99 \\ud800"):
        assert [x[4] for x in s.scan(text)] == [line], text


def test_wrapped_runs_and_members(monkeypatch):
    rng = random.Random(7)
    noise = " ".join(f"{rng.random()}" for _ in range(60))
    for pack in (lambda b: b, gzip.compress, zlib.compress, zstandard.compress, bz2.compress):
        plain = f"{noise[:53]} token=secret99 {noise}".encode()
        for data in (pack(plain), pack(noise.encode()) + pack(plain)):
            code = base64.encodebytes(data).decode().rstrip("\n")
            for sep in ("\n", "\r\n", "\n    "):
                wrapped = code.replace("\n", sep)
                assert (2, 2 + len(wrapped), "token=secret99") in [(x[1], x[2], x[4]) for x in s.scan(f"x {wrapped}\n\nplain words")]
    dump = re.sub("(.{30})", r"\1\n", b"some text password=hunter2222 and".hex())
    assert "password=hunter2222" in [x[4] for x in s.scan(dump)]
    monkeypatch.setattr(s, "CHUNK", 1 << 10)
    monkeypatch.setattr(s, "WINDOW", 1 << 12)
    monkeypatch.setattr(s, "TAIL", 1 << 11)
    for pack in (gzip.compress, zlib.compress, zstandard.compress, bz2.compress):
        keys = [f"token=secret{i:05}" for i in range(3000)]
        code = base64.b64encode(pack(pack(" é, ".join(keys).encode()))).decode()
        assert [x[4] for x in s.scan(f"x {code}")] == keys
    quoted = base64.b64encode(gzip.compress(("z" * 9000 + " " + LINE).encode())).decode()
    assert [x[4] for x in s.scan(quoted)] == [LINE[:-1]]
