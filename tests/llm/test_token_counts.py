import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from postresp.llm.token_counts import pieces, token_counts

TEXTS = [None, "", " ", "a", "Hello  world it's <|endoftext|> x\n\n\t y ", "é ü 漢字 " * 50, "don't we'll 123 45.6!!!  ",
         "<|endoftext|>", "word " * 40000, "x" * 30000, "a  b   c \n d" * 3000, " lead", "trail ", "nbsp here   em",
         "same", "same"]


def library_counts(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def test_counts_equal_the_library(spark):
    rows = [(i, x, "extra") for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for size in (64, 1 << 16):
        got = {r.doc_id: r for r in token_counts(docs, piece_chars=size, batch_bytes=1000).collect()}
        assert [got[i].n_tokens for i in range(len(TEXTS))] == library_counts(TEXTS)
        assert [got[i].n_bytes for i in range(len(TEXTS))] == [len((x or "").encode()) for x in TEXTS]


def test_query_equals_the_library(spark):
    from postresp.llm.queries import op4_token_counts
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op4_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, library_counts([d.text for d in docs])):
        assert (got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (n, n > 512)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies(spark, name):
    docs = spark.createDataFrame([(1, "a short text"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, name).collect()}
    assert got[2] == 0 and got[1] >= 3


def test_pieces_join_back():
    for x in TEXTS:
        if x:
            assert "".join(pieces(x, 100)) == x


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
