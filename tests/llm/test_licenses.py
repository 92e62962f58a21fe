import re
from collections import Counter

from tideglass.llm import licenses as lic

LOWER = str.maketrans(lic._UPPER, lic._LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows):
    split = [words(t) for _, t in rows]
    df = Counter(w for ws in split for w in set(ws))
    out = []
    for (key, _), ws in zip(rows, split):
        starts, base = [], set()
        for phrase, label in lic.PHRASES:
            parts = phrase.split()
            found = [i for i in range(len(ws)) if ws[i : i + len(parts)] == parts]
            starts += found
            base |= {label} if found else set()
        shares, sure, labels = {}, 0.0, set(base)
        for name, (text, keys) in lic.TEMPLATES.items():
            line = text.split()
            own = sorted(set(line) & set(ws), key=lambda w: (df[w], w))
            shares[name] = 0.0
            if len(own) < lic.LEAST_SHARE * len(set(line)):
                continue
            begins = {w: {i - p for i, x in enumerate(ws) for p, y in enumerate(line) if x == y == w} for w in own[: lic.RARE]}
            edges = {lic.SPAN * (b // lic.SPAN + d) for bs in begins.values() for b in bs for d in (0, -1)}
            most = max(sum(any(e <= b < e + 2 * lic.SPAN for b in bs) for bs in begins.values()) for e in edges)
            shares[name] = most / lic.RARE
            if shares[name] >= lic.LEAST_SHARE and all(f" {k} " in f" {' '.join(ws)} " for k in keys):
                labels.add(name)
                sure = max(sure, shares[name])
        score = 1.0 if starts else sure if sure else max(shares.values()) / 2
        out.append((key, len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def test_rows_equal_plain_search(spark):
    texts = [
        None, "", " ", "Released under the MIT License.", "MIT; license mit license, MIT-LICENSE", "the general public license general public",
        "Licensed under the Apache License, Version 2.0.", "mit é license", "MİT license", "license", "public general license",
        *[t for t, _ in lic.TEMPLATES.values()],
        *[("intro words " + t.upper() + " and more").replace(" the ", " the, ") for t, _ in lic.TEMPLATES.values()],
        lic.TEMPLATES["bsd"][0].replace("binary", "linary"), lic.TEMPLATES["gpl"][0].replace("program", "thing"),
        " ".join(lic.TEMPLATES["isc"][0].split()[::-1]), "x " * 20000 + lic.TEMPLATES["mpl"][0] + " y" * 20000,
        (lic.TEMPLATES["mit"][0] + " ") * 3, "hereby granted permission", "copy of the the of copy",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id bigint, text string, words string, score int")
    found = sorted(map(tuple, lic.scan(docs).collect()), key=repr)
    assert found == plain(rows)
    assert {r[6] for r in found} >= {"mit", "apache", "gpl", "bsd", "mpl", "isc", "unlicense", "cc-by", "zlib", "boost"}
    assert lic.scan(docs.limit(0)).collect() == []


def outside_keys(template):
    """Places of a template's words that belong to no key phrase."""
    text, keys = lic.TEMPLATES[template]
    line = text.split()
    inside = set()
    for key in keys:
        parts = key.split()
        for i in range(len(line)):
            if line[i : i + len(parts)] == parts:
                inside |= set(range(i, i + len(parts)))
    return line, inside


def test_one_word_more_or_less_keeps_the_label(spark):
    rows = []
    for name in lic.TEMPLATES:
        line, inside = outside_keys(name)
        for i in range(len(line)):
            if i not in inside:
                rows += [(len(rows), name, " ".join(line[:i] + line[i + 1 :])), (len(rows) + 1, name, " ".join(line[:i] + ["other"] + line[i + 1 :]))]
            if i not in inside or i - 1 not in inside:
                rows.append((len(rows), name, "before " * (i % 5) + " ".join(line[:i] + ["extra"] + line[i:])))
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id bigint, text string")
    labels = {r["doc_id"]: r["labels"].split(",") for r in lic.scan(docs).collect()}
    assert len(rows) > 400
    assert [(k, n) for k, n, _ in rows if n not in labels[k]] == []


def test_rare_words_are_each_files_own(spark):
    line, inside = outside_keys("mit")
    gone = {"without", "restriction", "any", "associated"}
    assert not {line[i] for i in inside} & gone
    # These four are the template's rarest words over the corpus; the file's own rarest are others.
    texts = [" ".join(w for w in line if w not in gone), *[" ".join(line)] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["labels"] for r in lic.scan(docs).collect()} == {i: "mit" for i in range(4)}


def test_scattered_words_are_no_licence(spark):
    for name, (text, keys) in lic.TEMPLATES.items():
        line = text.split()
        far = " ".join(f"{w} {'x ' * 20}" for w in line) + " " + " ".join(keys)
        rows = [(0, far), (1, " ".join(reversed(line)))]
        found = lic.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert all(name not in r["labels"].split(",") for r in found.collect()), name


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id bigint, text string")
    plan = lic.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
