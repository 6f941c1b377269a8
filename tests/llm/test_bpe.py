import random
import re

import corpus
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptgrid.llm import bpe, token_counts

CODEC = bpe.Codec.of(bpe.VOCABULARY)
TEXTS = st.text(alphabet="ab 'stre\n\t.,!0é日🙂\xa0 ", max_size=300)


@settings(max_examples=800, deadline=None)
@given(TEXTS, st.integers(1, 40), st.sampled_from([1, 4, 1024]))
def test_tree_equals_plain_encoding(text, leaf, near):
    bpe.NEAR_CHARS = near
    tokens = CODEC.encode(text, leaf)
    assert tokens == CODEC.plain.encode_ordinary(text)
    assert CODEC.decode(tokens) == text


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40), st.integers(1, 12))
def test_spliced_counts_equal_whole(text, chunk, overlap):
    assert token_counts.count(CODEC, text, chunk, overlap)[0] == len(CODEC.plain.encode_ordinary(text))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_long_texts_and_vocabularies(name):
    codec = bpe.Codec.of(f"/opt/tokenizers/{name}")
    rng = random.Random(3)
    for text in (" ".join(corpus.text(rng, 300) for _ in range(60)), "a" * 20_000, " " * 5_000 + "b", "it's we'll " * 3000, "no'" * 4000):
        whole = codec.plain.encode_ordinary(text)
        assert codec.encode(text) == whole
        assert codec.decode(whole) == text
        counted, chunks, widened = token_counts.count(codec, text)
        assert counted == len(whole)


def test_overlaps_widen_where_nothing_is_stable():
    text = "a" * 100 + " " + "b" * 100
    counted, chunks, widened = token_counts.count(CODEC, text, 20, 4)
    assert counted == len(CODEC.plain.encode_ordinary(text)) and widened > 0


def test_tokens_that_split_characters_decode():
    text = "🙂日本語" * 900
    assert CODEC.decode(CODEC.encode(text, 64)) == text


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    rows = bpe.decode(bpe.encode(docs)).collect()
    counts = token_counts.token_counts(docs).collect()
    assert len(rows) == len(counts) == docs.count()
    key = lambda i, n: (i is not None, i or 0, n is not None, n or 0)
    assert sorted((key(r["doc_id"], r["n_tokens"]) for r in rows)) == sorted(key(c["doc_id"], c["n_tokens"]) for c in counts)
    texts = sorted(r["text"] for r in docs.collect() if r["text"] is not None)
    assert sorted(r["decoded"] for r in rows if r["decoded"] is not None) == texts
    for r in rows:
        assert (r["token_ids"] is None) == (r["n_tokens"] is None) == (r["decoded"] is None)


def test_bad_parameters(spark):
    with pytest.raises(ValueError, match="positive"):
        token_counts.token_counts(corpus.frame(spark, []), chunk=0)


def test_kinds_of_characters_are_the_tokenizers():
    letter = re.compile(f"[{bpe._class(chr(92) + 'p{L}')}]")
    assert all(letter.match(c) for c in "aéß日かऄЖ") and not any(letter.match(c) for c in "1 .'\u0301🙂٣")


def test_text_without_stable_places_is_encoded_once(monkeypatch):
    encoded = []
    plain = CODEC.plain.encode_ordinary

    class Counting:
        def encode_ordinary(self, text):
            encoded.append(len(text))
            return plain(text)

    rng = random.Random(8)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) + "。" * (rng.random() < 0.0005) for _ in range(60_000))):
        encoded.clear()
        with monkeypatch.context() as m:
            m.setattr(CODEC, "plain", Counting())
            tokens = CODEC.encode(text)
        assert tokens == plain(text) and sum(encoded) <= 1.2 * len(text)


def test_rows_decode_together_as_alone(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "🙂日本語", "a", corpus.text(rng, 400), None, "é" * 50, corpus.text(rng, 30)]
    lists = [None if t is None else CODEC.plain.encode_ordinary(t) for t in texts]
    odd = [CODEC.plain.encode_ordinary("🙂")[:1], CODEC.plain.encode_ordinary("🙂")[1:]]
    for leaf in (3, 100, bpe.LEAF_TOKENS):
        monkeypatch.setattr(bpe, "LEAF_TOKENS", leaf)
        for rows in (lists, lists + odd):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int32())), pa.array([None if r is None else len(r) for r in rows], pa.int64())], ["doc_id", "token_ids", "n_tokens"])
            got = [t for b in bpe._decoder(bpe.VOCABULARY)(iter([batch.slice(0, 1), batch.slice(1)])) for t in b.column(3).to_pylist()]
            assert got[: len(texts)] == texts and got[len(texts) :] == [CODEC.plain.decode_bytes(o).decode(errors="replace") for o in rows[len(texts) :]]
    with pytest.raises(KeyError):
        CODEC.decode([10**6])
