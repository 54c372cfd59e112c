import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajspark.llm.bpe import StreamDecoder, StreamEncoder, Vocabulary, decode, encode, encode_text, lengths

V = Vocabulary.load()


def stream(text, step):
    s, out = StreamEncoder(V), []
    for i in range(0, len(text), step):
        out += s.feed(text[i : i + step])
    return out + s.finish()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab zé's!?\n\t1٣กข天。🦾\xa0"), max_size=400), st.integers(1, 50))
def test_chunks_do_not_change_tokens(text, step):
    assert stream(text, step) == V.encoding.encode_ordinary(text)


def test_runs_longer_than_the_lookahead():
    r = random.Random(3)
    parts = ["a", "b", " ", "\n", "'s", "'", "'ll", "1", "é", "中", "!", "\x1c", "\u2003", "\u3000", "ไ", "word ", " the"]
    for _ in range(3000):
        text = "".join(r.choice(parts) * r.choice([1, 2, 5, 150, 300]) for _ in range(r.randint(0, 8)))
        assert stream(text, r.choice([1, 7, 33, 256])) == V.encoding.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop", "0123456789", "!?-=", "กขคงจ", "天地玄黄", "x", " ", " \n\t"])
def test_long_pieces_stream_within_constant_memory(alphabet):
    r = random.Random(alphabet)
    text = "hello " + "".join(r.choice(alphabet) for _ in range(3000)) + " end"
    s, out, held = StreamEncoder(V), [], 0
    for i in range(0, len(text), 64):
        out += s.feed(text[i : i + 64])
        held = max(held, len(s.held) + (len(s.piece.held) if s.piece else 0))
    out += s.finish()
    assert out == V.encoding.encode_ordinary(text)
    assert held < 1500


def test_decoder_holds_back_unfinished_characters():
    ids = encode_text("a🦾ก", V)
    d = StreamDecoder(V)
    parts = [d.feed([i]) for i in ids]
    assert "".join(parts) + d.finish() == "a🦾ก" and "" in parts


def test_against_the_library_over_all_documents(spark, data):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in encode(docs).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        assert got[k] == (t.encode(text, add_special_tokens=False).ids if text else [])
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs)).collect()}
    assert all(back[k] == (v or "") for k, v in texts.items())


def test_special_strings_null_empty_and_long(spark):
    rows = [(1, "<|endoftext|> x"), (2, ""), (3, None), (4, "word " * 60_000), (5, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert 50256 not in got[1] and got[2] == [] and got[3] == []
    assert got[4] == V.encoding.encode_ordinary(rows[3][1]) and got[5] == V.encoding.encode_ordinary(rows[4][1])
    assert {r["doc_id"]: r["n_tokens"] for r in lengths(df).collect()} == {k: len(v) for k, v in got.items()}
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
