import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postresp.llm.bpe import Memo, bpe_decode, bpe_encode, codec, merge_symbols

FILE = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(FILE)
TEXTS = [None, "", " \n\t", "Hello WORLD it's  <|endoftext|>x <|startoftext|>", "ΑΣ Σ ΟΔΟΣ İ ẞ ½ ²", "a\x1cb\x1dc\x85d e",
         "é Å ẛ̣", "x" * 20000, "don't 'S 't're!!'s", "漢字 かな 한국어 \U0001F600\U0001F3FD", "ab " * 30000, "dup", "dup",
         "ᲉꟋ \U000105c0", "<|endoftext|>", "<|endof"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


def test_texts_equal_the_library(spark):
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids int")
    outputs = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    encoded = bpe_encode(docs, outputs=outputs)
    back = {r.doc_id: r.decoded for r in bpe_decode(encoded).collect()}
    for r in encoded.collect():
        ids, text = expected(TEXTS[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text == back[r.doc_id]
        assert r.ids_sha256 == sha(" ".join(map(str, ids))) and r.decoded_sha256 == sha(text)


def test_ascii_texts_skip_the_normaliser_and_odd_letters_are_found(monkeypatch):
    c = codec(FILE)
    assert c.plain_ascii and not c.odd("plain é漢") and all(c.odd(f"é{chr(p)}") for p in c.lower)
    monkeypatch.setattr(c, "odd", None)             # a text in ASCII is not looked through for odd letters
    assert c.normalised("Hello WORLD\x1c") == "hello world\x1c"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcthe '\n<|>endoftext1é"))))
def test_any_text_equals_the_library(text):
    c = codec(FILE)
    assert c.encode(text) == LIB.encode(text, add_special_tokens=False).ids


def test_merges_take_the_lowest_rank_then_the_leftmost():
    a, aa = 1, 2
    assert merge_symbols([a] * 5, {a << 20 | a: 0, aa << 20 | aa: 1}, [aa, 3]) == [3, a]
    assert merge_symbols([a, 9, a], {a << 20 | a: 0}, [aa]) == [a, 9, a]
    assert merge_symbols([], {}, []) == []


def test_memo_is_bounded():
    calls = []
    memo = Memo(lambda k: calls.append(k) or k, size=3)
    for k in "abcdabcd":
        assert memo[k] == k
    assert len(memo) <= 3 and len(memo.last) <= 3


def test_query_equals_the_library(spark):
    from postresp.llm.queries import op9_bpe
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op9_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, text = expected(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_decoding_refuses_unknown_ids(spark):
    with pytest.raises(Exception):
        bpe_decode(spark.createDataFrame([(1, [10 ** 6])], "doc_id long, ids array<int>")).collect()


def test_empty_table(spark):
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
