import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'srevlmdt \n\t1a-Aé́ <|>"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_words_encode_as_whole_texts(library, texts):
    for text, ids in zip(texts, tf.encode_texts(texts, PATH), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_words_take_the_short_way(library):
    words = tf.word_ids(PATH)
    assert words.short
    for word in ("Thnble.", "ÄPFEL?!", "straße", "don't", "a1", ".", "..x", "x.y.", "É", "ÿ", "İ", "<|endoftext|>.", "é", "Ωmega"):
        whole = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(words[word], dtype="<u4").tolist() == whole


def test_any_ascii_mark_ends_a_plain_word(library):
    words = tf.WordIds(PATH)
    for mark in filter(lambda c: not c.isalnum(), map(chr, range(33, 127))):
        for word in (f"thnble{mark}", f"été{mark * 3}", f"a{mark}'", f"x.{mark}"):
            whole = library.encode(word, add_special_tokens=False).ids
            assert np.frombuffer(words._short(word), dtype="<u4").tolist() == whole


def test_lower_casing_a_text_changes_no_id(library):
    assert tf.word_ids(PATH).caseless
    texts = [
        "<|StartOfText|> A", "x<|ENDOFTEXT|>Y <|endoftext|>", "İI Σας ΣΑΣ", "It'S don'T I'LL''S", "µM ªº ß X²Y½ ¿Q¡R",
        "".join(map(chr, range(256))), *[f"A{chr(c)}B {chr(c)} C{chr(c)}'S" for c in range(256)],
    ]
    for text, ids in zip(texts, tf.encode_texts(texts, PATH), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6000), st.integers(1, 300), st.integers(0, 2**32 - 1))
def test_coder_round_trip_and_slices(n, kinds, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    table = tf.Table.of(np.bincount(ids))
    data = tf.pack_block(3, 1, 77, [5, None], [n, 0], ids, table)
    (block,) = tf.read_blocks(data + b"\n")
    assert block.keys == [5, None] and (block.part, block.number, block.offset) == (3, 1, 77)
    assert (block.ids(table) == ids).all()
    a = int(rng.integers(0, n))
    b = int(rng.integers(a, n)) + 1
    assert (block.slice(a, b, table) == ids[a:b]).all()


def test_many_steps_have_checkpoints():
    ids = (np.arange(400_000) ** 2 % 977).astype(np.uint32)
    table = tf.Table.of(np.bincount(ids))
    (block,) = tf.read_blocks(tf.pack_block(0, 0, 0, [1], [len(ids)], ids, table) + b"\n")
    assert len(block.checkpoints) > 1
    assert (block.slice(300_000, 300_100, table) == ids[300_000:300_100]).all()
    assert block.stream.nbytes < ids.nbytes / 2


def test_damage_is_seen():
    ids = np.arange(100, dtype=np.uint32)
    data = bytearray(tf.pack_block(0, 0, 0, [1], [100], ids, tf.Table.of(np.bincount(ids))))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(tf.read_blocks(bytes(data)))


def test_rows(spark, library):
    rows = [(7, "b c"), (3, "Some Words it's"), (None, "null id"), (9, None), (8, ""), (3, "Some Words it's"), (-1, "é " * 40000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, start string")
    found = [tuple(r) for r in tf.round_trip(docs, PATH).collect()]
    coded = sorted(
        ((k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0),
    )
    wanted, start = [], 0
    for key, ids in coded:
        wanted.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == wanted
    assert tf.round_trip(docs.limit(0), PATH).collect() == []
