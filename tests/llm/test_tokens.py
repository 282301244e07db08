"""op10 against the library on whole texts."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from viewspan.llm.tokens import Counter, op10_token_counts, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark, whole):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = whole(docs[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)


def test_edge_rows(spark, whole):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "é É x"), (5, "it's 2024 don't " * 9000)]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_tokens int")
    out = sorted(((r[0] or 0, r[1], r[2], r[3]) for r in token_counts(df, PATH).collect()))
    assert out == sorted(((d or 0, len((t or "").encode()), whole(t), whole(t) > 2048) for d, t in rows))
    assert token_counts(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("unit", ["word ", "no blank at all", "é́\n\n ", "<|endoftext|>", "a <|startoftext|>b ", "   ", "it's we'll 12,345 !!! ", "x́ ́y ", "日本語 テキスト。"])
@pytest.mark.parametrize("chunk,overlap", [(64, 16), (50, 30), (200, 8)])
def test_splices_are_exact(whole, unit, chunk, overlap):
    text = "".join(unit + "abc"[k % 3] * (k % 5) for k in range(150))
    assert Counter(PATH, chunk, overlap).spliced(text) == whole(text)


def test_sentencepiece(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", "hello world", "a b " * 30]
    p = SentencePieceProcessor(model_file=path)
    assert Counter(path, 16, 4).counts(texts) == [len(p.encode(t)) for t in texts]


def test_tokens_that_hold_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "hello world", "a  b\n\n c <|endoftext|> d", "some more words " * 50]
    assert Counter(path, 64, 16).counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


_COUNTER = Counter(PATH)
_WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "\n", "\t", "\u00a0", "\u0301", "<|endoftext|>", "<|start", "oftext|>", "'s", "ΑΣ", "12", "é", "\u1100\u1161", "\x1c", "\u2028"])), max_size=20))
def test_pieces_are_exact(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert _COUNTER.counts([text]) == [len(_WHOLE.encode(text, add_special_tokens=False).ids)]
