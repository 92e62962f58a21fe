import base64
import hashlib

from tideglass.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        holder = max(same, default=None)
        big = len((html or "").encode()) >= least
        refers = holder if big and holder is not None and page != holder else None
        kind = "response" if refers is None else "revisit"
        out.append((page, len((html or "").encode()), digest(html), kind, refers, True))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (3, None, "same"), (2, "http://c/\r\nX: y", None),
    (4, "", ""), (6, "http://d/", "é" * 100_000), (7, "http://e/", "WARC/1.1\r\n\r\n" * 50), (8, "u", "x" * 65536),
    (9, "u", "é" * 100_000), (None, "n", "same"), (None, "n", "alone"), (6, "http://d/", "é" * 100_000), (10, "u", "\r\n\r\n"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(p, u, h, "z") for p, u, h in ROWS], "page_id bigint, url string, html string, record_type string")
    found = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    assert found == expected(ROWS)
    small = warc.round_trip(pages, str(tmp_path / "small"), least_bytes=10, segment_bytes=100).collect()
    assert sorted(map(tuple, small), key=repr) == expected(ROWS, least=10)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>")], "page_id bigint, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "w"))
    data = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))
    assert path and data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"0\r\n\r\n\r\n\r\n")
    assert "é".encode() in data


def test_missing_and_shuffled_segments():
    records = list(warc.page_records(1, "u", b"y" * 5000, None, segment_bytes=1000))
    rows = []
    for record in records:
        ((headers, block),) = warc.parse_records(record + b"\r\n\r\n")
        fields = "\n".join(f"{k}: {v}" for k, v in headers.items())
        total = headers.get("warc-segment-total-length")
        rows.append({"number": int(headers["warc-segment-number"]), "total": int(total) if total else None, "headers": fields, "block": block})
    whole = warc._assembled(rows[::-1])
    assert whole == [[1, 5000, payload := warc.payload_digest(b"y" * 5000), "response", None, True]] and payload
    for lost in range(len(rows)):
        ((page, size, _, _, _, intact),) = warc._assembled(rows[:lost] + rows[lost + 1 :])
        assert (page, size, intact) == (1, None, False)


def test_broken_chunks():
    for block in (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", b"", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"):
        assert warc.decode_block("response", "X", block) is None


def test_damaged_archives_cost_only_what_they_hit(spark, tmp_path):
    end = b"\r\n\r\n"
    records = [r for page in range(1, 6) for r in warc.page_records(page, "u", (f"<p>{page}</p>" * page * 40).encode(), None, segment_bytes=600)]
    parsed = list(warc.parse_records(b"".join(r + end for r in records)))
    assert len(parsed) == len(records) and all(block is not None for _, block in parsed)
    first = next(warc.page_records(9, "u", b"some payload", None))
    length = first.index(b"Content-Length: ") + 16
    cases = {
        "cut_head": first[: length - 4],
        "cut_block": first[:-5],
        "too_long": first[:length] + b"9999999" + first[first.index(b"\r\n", length) :],
        "too_short": first[:length] + b"7" + first[first.index(b"\r\n", length) :],
        "no_number": first[:length] + b"x" + first[first.index(b"\r\n", length) :],
        "noise": b"\xff\0noise" * 9,
    }
    good = b"".join(r + end for r in records)
    for name, bad in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part-0").write_bytes(bad + end + good)
        (folder / "part-1").write_bytes(bad)
        rows = sorted(map(tuple, warc.read_archives(spark, str(folder)).collect()), key=repr)
        whole = [r for r in rows if r[5]]
        assert whole == sorted(((p, len(x := (f"<p>{p}</p>" * p * 40)), digest(x), "response", None, True) for p in range(1, 6)), key=repr), name
        rest = [r for r in rows if not r[5]]
        assert len(rest) == 2 and all(r[1:3] == (None, None) for r in rest)
        assert name == "noise" or [(r[0], r[3]) for r in rest] == [(9, "response")] * 2, name


def test_a_damaged_segment_spoils_its_page_only(spark, tmp_path):
    end = b"\r\n\r\n"
    one, two = (list(warc.page_records(p, "u", b"y" * 5000, None, segment_bytes=1000)) for p in (1, -2))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0").write_bytes(b"".join(r + end for r in [*one[:2], one[2][:-9], *one[3:], *two]))
    rows = sorted(map(tuple, warc.read_archives(spark, str(tmp_path / "w")).collect()))
    assert rows == [(-2, 5000, warc.payload_digest(b"y" * 5000), "response", None, True), (1, None, None, "response", None, False)]
