import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from tideglass.llm import byte_bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = [
    "", " ", "  ", "\n", " \n", "\n ", "a", "'s", "''s", " 's", "\n's", "a's", "a'sb", "'re", "'r", "'rx", "'ra'll",
    "'l", "'ll", "'lx", "'v 've", "x'r'e", "'r'", "'r's", "'re're", "1's", "-'s", "' s", "a  b", "a \n b", "a b",
    "a  b", "a  b", "   ", "\t\tx", "x\t\t", "é'd ü's", "'S 'Re", "don't we'll they've I'm he'd you're",
    "日本語 テスト 123 ①²", "🙂🙂 a🙂", "á é", "x" * 3000, "ab" * 700 + "1" * 300, "!?" * 400, "\x1c\x1d a",
    "'l'l'll'r'v'", "'lll", "'rere", "l'l l'll", " a", " '", " ' ", "a' b", "<|endoftext|>", " \U0001f1e6",
]


def check(library, texts):
    for text, (joined, ids) in zip(texts, byte_bpe.encode_texts(texts, PATH), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert joined == " ".join(map(str, ids.tolist()))


def test_hard_texts_alone_and_together(library):
    for text in HARD:
        check(library, [text])
    check(library, HARD)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'srevlmdt \n\t1a-"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_random_texts(library, texts):
    check(library, texts)


def test_rows(spark, library):
    rows = [(1, "some words' re", "x"), (None, None, "y"), (1, "some words' re", None), (3, "", ""), (4, "it's\n\n ok ", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    found = sorted(map(tuple, byte_bpe.round_trip(docs, PATH).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for key, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        wanted.append((key, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert found == sorted(wanted, key=repr)
    assert byte_bpe.round_trip(docs.limit(0), PATH).collect() == []
