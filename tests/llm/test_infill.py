import hashlib
import random
import re

import pytest

from tideglass.llm import infill

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def plain(key, text):
    """One text by string operations: units, form, characters of prefix and middle, output."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_random_texts_and_back(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    rng = random.Random(block)
    pieces = ["a", "B", "é", "<", "P", "S", ">", "\n", "😀", "<P>", "zz", " ", "\0", "<S"]
    for _ in range(150):
        keys = [rng.choice([None, -5, rng.randrange(10**6)]) for _ in range(6)]
        texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in keys]
        done = infill.transform(keys, [t.encode() for t in texts])
        assert infill.restore([d.output for d in done], [d.form for d in done]) == [t.encode() for t in texts]
        for key, text, d in zip(keys, texts, done, strict=True):
            chars = (None, None) if d.form == infill.PLAIN else (d.prefix_chars, d.middle_chars)
            assert (d.units, infill.FORMS[d.form], *chars, d.output.decode()) == plain(key, text)


def test_cuts_at_both_ends(monkeypatch):
    """A draw of 0 or n leaves parts empty; they come back all the same."""
    for a in (0, 1, 3):
        for b in (0, 2, 3):
            for spm in (0, 50):
                monkeypatch.setattr(infill, "draws", lambda key, seed, h=(a, b, 0, spm): h)
                (done,) = infill.transform([1], [b"ab,c"])
                assert infill.restore([done.output], [done.form]) == [b"ab,c"]
                assert done.form == (infill.SPM if spm < 20 else infill.PSM)


def test_marks_beside_look_alikes():
    for text in ("<<S>".replace("<S>", "<S"), "S><P", "<M<S<P", "P>M>S>"):
        for form in (infill.PSM, infill.SPM):
            for cut in range(len(text) + 1):
                parts = [(cut, 0, len(text) - cut)]
                import numpy as np

                output = infill.moves(parts, [form]).scatter(np.frombuffer(text.encode(), np.uint8)).tobytes()
                assert infill.restore([output], [form]) == [text.encode()]


def test_odd_rows(spark):
    long = "word, " * 300_000
    rows = [(1, None, 7), (1, "", 7), (None, "some text here", 8), (2, "twice", 1), (2, "twice", 1), (3, "has <P> in it", 0), (4, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    found = infill.report(docs)
    assert tuple(found.columns) == COLUMNS
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = []
    for key, text, _ in rows:
        *shape, output = plain(key, text or "")
        wanted.append((key, *shape, digest(output), digest(text or "")))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert infill.report(docs.limit(0)).collect() == []
    outputs = infill.infilled(docs)
    assert sorted(map(tuple, infill.restored(outputs).collect()), key=repr) == sorted(((k, t or "") for k, t, _ in rows), key=repr)
