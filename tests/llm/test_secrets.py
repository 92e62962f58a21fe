import base64
import bz2
import gzip
import hashlib
import io
import json
import lzma
import random
import re
import tarfile
import zipfile
import zlib
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import secrets

AKIA = "AKIA" + "ABCDEFGH12345678"


def plain(text):
    """The contract's patterns, tried position by position."""
    found = []
    for kind, (pattern, flags, enough) in enumerate(
        [
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
            (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
            (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
        ]
    ):
        at, matcher = 0, re.compile(pattern, flags)
        while at <= len(text):
            m = matcher.match(text, at)
            if m is None:
                at += 1
                continue
            if enough(m):
                found.append((m.start(), kind, m.end()))
            at = m.end()
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc", "deadbeef01", "AKIA", "AKIA0123456789", "ZZ9", "é", "\n", "%41", "g"]), max_size=30).map("".join))
def test_base_equals_plain_search(text):
    base, spans, _, _ = secrets.find_all(text)
    assert base == plain(text)
    assert set(base) <= set(spans)


def layers_of(text):
    base, spans, layers, cut = secrets.find_all(text)
    return base, spans, layers


def test_base64_layer_is_mapped():
    inner = base64.b64encode(f"note {AKIA} end".encode()).decode()
    text = f"see {inner} there"
    base, spans, layers = layers_of(text)
    assert base == [] and layers >= 1
    ((start, kind, end),) = spans
    assert kind == 1 and 4 <= start < end <= 4 + len(inner)
    covered = base64.b64decode(text[start - (start - 4) % 4 : end + (-(end - 4)) % 4])
    assert AKIA.encode() in covered


def test_percent_and_unicode_layers():
    text = "q=" + quote("password: hunter22 é", safe="")
    assert [k for _, k, _ in layers_of(text)[1]] == [0]
    text = "".join(f"\\u{ord(c):04x}" for c in "token=abcdef") + "!"
    assert layers_of(text)[1] == [(0, 0, len(text) - 1)]
    assert layers_of("&#116;oken=abcdef")[1] == [(0, 0, 17)]
    assert layers_of("\\ud83d\\ude00 token=abcdef")[1] == [(13, 0, 25)]


def test_nested_and_compressed_layers():
    for pack in (gzip.compress, zlib.compress, bz2.compress):
        deep = base64.b64encode(pack(base64.b64encode(f"x {AKIA}".encode()))).decode()
        text = "a " + quote(deep, safe="") + " b"
        spans = layers_of(text)[1]
        assert (2, 1, len(text) - 2) in spans


def test_cycles_and_damage_end():
    for text in ("%25" * 50 + "41", "%", "%zz", "\\u", "&#99999999;", "A" * 500, "\\ud800", "%ff%fe", "=" * 40, "H4sI" + "A" * 60):
        secrets.find_all(text)
    assert secrets.redact("a token=abcdef, " + "0" * 24 + "!") == "a [secret], [secret]!"
    assert secrets.redact("") == ""


def test_rows(spark):
    rows = [(1, "token = abcdef", "x"), (None, None, None), (2, "", "y"), (1, "token = abcdef", "x"), (3, "é " * 50000 + AKIA, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans, r.base_sha256) for r in secrets.report(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one, two = "assign:0:14", "access:100000:100020"
    assert found == {(1, 1, 0, 0, one, sha(one)), (None, 0, 0, 0, "", sha("")), (2, 0, 0, 0, "", sha("")), (3, 0, 1, 0, two, sha(two))}
    assert secrets.report(docs).count() == 5 and secrets.report(docs.limit(0)).count() == 0
    texts = [r.text for r in secrets.redacted(docs).collect()]
    assert texts.count("[secret]") == 2 and texts.count(None) == 1


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def kinds_in(data):
    token = base64.b64encode(data).decode()
    return {k for _, k, _ in layers_of(f"a {token} b")[1]}


PACKS = (gzip.compress, zlib.compress, bz2.compress, lzma.compress)


def test_compressed_in_compressed_and_members():
    inner = f"x {AKIA}".encode()
    for first in PACKS:
        for second in PACKS:
            assert kinds_in(first(second(inner))) == {1}
            assert kinds_in(first(noise(3000) + second(inner) + noise(3000))) == {1}
        assert kinds_in(first(b"nothing here") + first(b"nor here") + first(inner)) == {1}
    assert kinds_in(gzip.compress(b"toke") + gzip.compress(b"n=abcdef")) == {0}
    deep = inner
    for _ in range(300):
        deep = gzip.compress(deep)
    assert kinds_in(deep) == {1}


def test_layers_of_mixed_bytes():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in (("a", b"token=abcdef"), ("b.gz", gzip.compress(AKIA.encode()))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert kinds_in(out.getvalue()) == {0, 1}
    for code in ("utf-16", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert 1 in kinds_in(f"né {AKIA}, x".encode(code))
        assert 1 in kinds_in(zlib.compress(f"né {AKIA}, x".encode(code)))
    assert kinds_in(f"né {AKIA}, x".encode("latin-1")) == {1}
    assert kinds_in(noise(999) + AKIA.encode() + noise(999, 2)) == {1}


@pytest.mark.parametrize("width, end", [(76, "\n"), (64, "\r\n"), (20, "\n  "), (10, "\n")])
def test_base64_in_lines(width, end):
    plain_text = "words before " * 20 + AKIA + " and behind" * 20
    for data in (plain_text.encode(), gzip.compress(noise(500).hex().upper().encode() + plain_text.encode())):
        token = base64.b64encode(data).decode()
        wrapped = end.join(token[i : i + width] for i in range(0, len(token), width))
        text = f"Content\n\n{wrapped}\n\nmore text"
        found = [(a, b) for a, k, b in layers_of(text)[1] if k == 1]
        assert found and AKIA not in secrets.redact(text)
        assert all(text.index(token[:8]) <= a < b <= text.index("\n\nmore") for a, b in found)


@pytest.mark.parametrize("glue", ["path/to/", "x", "ab", "a_b-", "word/x"])
def test_base64_glued_to_a_word(glue):
    for data in (f"the note {AKIA} ends".encode(), gzip.compress(f"the {AKIA}".encode())):
        token = base64.b64encode(data).decode()
        for tail in ("", "Q", "Qx", "/tail"):
            text = f"see {glue}{token.rstrip('=')}{tail} there"
            (*_, (start, kind, end)) = layers_of(text)[1]
            assert kind == 1 and 4 <= start < end <= len(text) - 6


def test_compressed_content_is_scanned_to_its_end(monkeypatch):
    assert 1 in kinds_in(zlib.compress(b"many words, " * (6 << 20) + AKIA.encode()))
    monkeypatch.setattr(secrets, "PIECE", 1 << 10)
    rng = random.Random(5)
    for n in range(0, 4000, 233):
        for fill in (b"A", b"\0", b" ", b"w, ", b"w-, "):
            assert kinds_in(gzip.compress(fill * n + b", token = abcdef ," + fill * 50)) == {0}
        middle = gzip.compress(rng.randbytes(3000) + f" {AKIA} ".encode() + rng.randbytes(3000))
        for data in (middle, base64.b64encode(middle), base64.encodebytes(middle), base64.b64encode(middle).decode().encode("utf-16-le")):
            assert kinds_in(gzip.compress(rng.randbytes(n) + b", " + data)) == {1}


def test_streams_behind_any_wrapper():
    inner = f"x {AKIA} y".encode()
    packed = gzip.compress(inner)
    percent = "".join(f"%{b:02x}" for b in packed)
    chains = [percent, quote(packed, safe=""), "".join(f"\\x{b:02x}" for b in packed), repr(packed), json.dumps(packed.decode("latin-1"))]
    chains += [quote(percent, safe=""), base64.b64encode(percent.encode()).decode(), quote(quote(base64.b64encode(packed).decode(), safe=""), safe="")]
    for token in chains:
        spans = layers_of(f"a {token} b")[1]
        assert any(kind == 1 and 2 <= start < end <= 2 + len(token) for start, kind, end in spans), token
        assert AKIA not in secrets.redact(f"a {token} b")
    start, kind, end = layers_of(f"a {percent}%00%00 b")[1][-1]
    assert (start, kind, end) == (2, 1, 2 + len(percent))


def zipped(data, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        archive.writestr("first.txt", b"nothing " * 9)
        archive.writestr("a/second.txt", data)
    return out.getvalue()


def deflated(data, bits=-15):
    tool = zlib.compressobj(9, zlib.DEFLATED, bits)
    return tool.compress(data) + tool.flush()


def alone(data):
    return lzma.compress(data, format=lzma.FORMAT_ALONE)


def test_more_kinds_of_streams():
    inner = b"words and words, " * 30 + f"x {AKIA} y".encode()
    for bits in (9, 10, 12, 15):
        assert kinds_in(deflated(inner, bits)) == {1}
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_STORED):
        assert kinds_in(zipped(inner, method)) == {1}
    for pack in (deflated, alone, zipped):
        assert kinds_in(pack(inner)) == {1}
        assert kinds_in(gzip.compress(base64.b64encode(pack(inner)))) == {1}
    assert kinds_in(zipped(zipped(inner))) == {1} and kinds_in(gzip.compress(noise(5000) + zipped(inner))) == {1}


def test_a_dictionary_beyond_the_bound_is_damage():
    huge = lzma.compress(b"x" * 99 + AKIA.encode(), format=lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20}])
    huge = huge[:1] + (1 << 31).to_bytes(4, "little") + huge[5:]
    assert kinds_in(huge) == set()


def test_base64_split_by_escaped_line_ends():
    token = base64.b64encode(b"some words before " + AKIA.encode() + b" and words behind").decode()
    for width in (20, 40):
        text = '{"key": "' + "\\n".join(token[i : i + width] for i in range(0, len(token), width)) + '\\n"}'
        assert [k for _, k, _ in layers_of(text)[1]] == [1]
    assert {k for _, k, _ in layers_of(json.dumps(json.dumps({"password": "hunter22"})))[1]} == {0}


def test_contents_met_before_end_at_any_size(monkeypatch):
    """A stream whose contents hold a stream with the same contents: as in one that unpacks to itself."""
    monkeypatch.setattr(secrets, "PIECE", 1 << 10)
    pieces = [random.Random(3).randbytes(1500) + b", " for _ in range(9)]
    searched = []
    original = secrets.Content._search
    monkeypatch.setattr(secrets.Content, "_search", lambda self, data: (searched.append(len(data)), original(self, data)))
    inside = secrets.Inside()
    for _ in range(2):
        content = secrets.Content(inside)
        for piece in pieces:
            content.push(piece)
        before = len(searched)
        content.end()
    assert len(searched) == before and content.unpackers == []


WRAPPERS = {
    "base64": base64.b64encode,
    "lines": base64.encodebytes,
    "percent": lambda d: quote(d, safe="").encode(),
    "every": lambda d: "".join(f"%{b:02X}" for b in d).encode(),
    "x": lambda d: "".join(f"\\x{b:02x}" for b in d).encode(),
    "u": lambda d: "".join(f"\\u{b:04x}" for b in d).encode(),
    "html": lambda d: "".join(f"&#{b};" for b in d).encode(),
    "json": lambda d: json.dumps(d.decode("latin-1")).encode(),
    "gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "alone": alone, "zip": zipped,
}
TEXTUAL = ("base64", "lines", "percent", "every", "x", "u", "html", "json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(sorted(WRAPPERS)), max_size=3), st.sampled_from(TEXTUAL), st.sampled_from([("token = hunter2222", 0), (AKIA, 1), ("0123456789abcdef" * 2, 2)]))
def test_random_chains(chain, last, secret):
    """Whatever is wrapped in up to four ways is found, as plain decoding in turn gives it back."""
    data = f"note, {secret[0]} , end".encode()
    for name in [*chain, last]:
        data = WRAPPERS[name](data)
    token = data.decode()
    # A letter behind the last line would be one more line of the token.
    text = f"a {token}, b"
    found = [(a, b) for a, kind, b in layers_of(text)[1] if kind == secret[1]]
    assert any(2 <= a < b <= 2 + len(token) for a, b in found), (chain, last)
