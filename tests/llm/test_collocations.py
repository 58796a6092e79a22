import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postresp.llm import collocations as C
from postresp.llm.collocations import collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, top, least):
    """Expected rows of (text, lang) pairs."""
    f = {}
    for text, lang in docs:
        count = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                count.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    rows = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        candidates = {g: c for g, c in count.items() if len(g) > 1 and c >= least}
        covered = set()
        for g, c in candidates.items():
            if len(g) == 3:
                covered |= {part for part in (g[:2], g[1:]) if 100 * c >= 50 * count[part]}
        found = []
        for g, a in candidates.items():
            if g not in covered:
                score, k = min((1000000 * a * a // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def docs_of(seed, size=400):
    rng = random.Random(seed)
    # words of very different frequency, some that go together
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(60)]
    out = []
    for k in range(size):
        words = []
        for _ in range(rng.randrange(40)):
            j = int(60 * rng.random() ** 3)
            words.append(vocab[j])
            if j % 5 == 0 and rng.random() < 0.8:
                words += [f"next{j}"] + ([f"third{j}"] if rng.random() < 0.7 else [])
        seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\xa0", "\x1f"]
        out.append(("".join(w + rng.choice(seps) for w in words), rng.choice(["en", "en", "fr", None, "und"])))
    return out + [(None, "en"), ("", None), ("  .,\n", "de"), ("same same " * 3000, "en"), ("x" * 200000 + " y", "de"), out[0], out[0]]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("top,least,slots", [(5, 3, 1 << 23), (40, 2, 1 << 23), (2000, 10, 1 << 23), (7, 2, 64)])
def test_equals_brute_force(spark, monkeypatch, top, least, slots):
    monkeypatch.setattr(C, "MAX_SLOTS", slots)
    docs = docs_of(top)
    df = spark.createDataFrame([(k, t, g, "x", 5) for k, (t, g) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, a int")
    got = rows_of(collocations(df.repartition(6), top, least))
    assert got == brute(docs, top, least) and len(got) > 10


def test_rounds_go_on_until_each_language_is_settled(spark, monkeypatch):
    """With pairs that are all dropped by longer phrases the first threshold does not settle."""
    rounds = []
    real = C._count_triples
    monkeypatch.setattr(C, "_count_triples", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(C, "AHEAD", 1)
    docs = [(f"a{k} b{k} c{k}", "en") for k in range(30)] * 2 + docs_of(3, 80)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert rows_of(collocations(df, 45, 2)) == brute(docs, 45, 2)
    assert len(rounds) > 1


def test_numbers_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, left, right = 10**14 - 1, 10**14 + 7, 10**14
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (11, 13, 17)], "a long, l long, r long")
    got = [r[0] for r in df.select(C._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000000 * a * a // (left * right), 1000000, 1000000 * 121 // (13 * 17)]


def test_hash_shared_by_two_words_is_noticed(spark, monkeypatch):
    real = C._count_words

    def clash(texts, seed):
        words = real(texts, seed)
        return words.withColumn("shared", C.F.lit(seed == 0))

    monkeypatch.setattr(C, "_count_words", clash)
    docs = docs_of(9, 60)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert C.counted_words(df)[2] == 1
    assert rows_of(collocations(df, 10, 2)) == brute(docs, 10, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).count() == 0
    assert collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_words_are_hashed_some_bytes_at_a_time(monkeypatch):
    texts = pa.array(["Ein Wort, " * 40, "x" * 300 + " b", None, "", "é b. b"])
    langs = pa.array(["de", "en", "en", "und", "fr"])
    whole = C.Words(texts, langs, 0)
    monkeypatch.setattr(C, "HASHED", 16)
    parts = C.Words(texts, langs, 0)
    assert np.array_equal(whole.keys, parts.keys) and np.array_equal(whole.ids, parts.ids)


def test_memory_of_a_slice():
    texts = pa.array(["".join(f"w{i % 5000} " for i in range(20_000))] * (C.SLICE // 115_000))
    langs = pa.array(["en"] * len(texts))
    tracemalloc.start()
    C.Words(texts, langs, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * C.SLICE
