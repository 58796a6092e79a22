import zlib

import numpy as np
from pyspark.sql import functions as F

from postresp.llm.language_id import build, fit, grams, identify, predict, HASHES

SAMPLES = {"en": "the house is on the hill and they went there with their mother", "de": "das haus ist auf dem berg und sie gingen mit der mutter",
           "fr": "la maison est sur la colline et ils sont avec leur mère"}


def gram_strings(text):
    """Brute force: the grams of one text, as strings."""
    out, flat = [], " "
    for c in text:
        c = c if len(c.lower()) != 1 else c.lower()
        c = c if c.isalpha() else " "
        if not (c == " " and flat[-1] == " "):
            flat += c
    if flat[-1] != " ":
        flat += " "
    for i in range(len(flat) - 3):
        g = flat[i:i + 4]
        if g[1] != " " and g[2] != " ":
            out.append(g)
    return out


def test_grams_equal_brute_force():
    texts = ["The house!!", None, "", "12 34", "a", "ab", "é漢字 İstanbul\tẞ", "x" * 10, " lead and trail "]
    hashes, doc, has = grams(texts)
    names = {}
    for i, t in enumerate(texts):
        own, expected = hashes[doc == i].tolist(), gram_strings(t or "")
        assert len(own) == len(expected)
        for h, g in zip(own, expected):
            assert names.setdefault(g, h) == h
        assert bool(has[i]) == any(c.isalpha() for c in t or "")
    assert len(set(names.values())) == len(names)


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    langs = [f"l{i:02d}" for i in range(11)]
    lang = rng.integers(0, 11, 3000)
    model = build(langs, np.full(11, 1 / 11), hashes, lang, 1 << 14)
    mask = np.full((3000, 2), 255, np.uint8)
    from postresp.llm.language_id import _slots
    for at in _slots(hashes, 1 << 14):
        mask &= model.slots[at]
    bits = np.unpackbits(mask, axis=1, bitorder="little")[:, :11]
    assert bits[np.arange(3000), lang].all()                    # never a miss
    other = (bits.sum() - 3000) / (3000 * 10)
    assert abs(other - model.false_positive.mean()) < 0.01 and HASHES == 3


def test_edge_cases(spark):
    rows = [(i * 3 + k, t, lang, 5) for i in range(20) for k, (lang, t) in enumerate(SAMPLES.items())] + [(900, None, "xx", 1), (901, "text", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = fit(df)
    assert model.langs == ["de", "en", "fr"]
    ask = [(1, None), (2, ""), (3, "123 !"), (4, "z"), (5, "the mother went there"), (6, "la mère et la colline"), (6, "das haus"),
           (7, "the house " * 20000), (None, "und der berg")]
    got = identify(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", got[3].lang_pred, "en", "fr", "de", "en", "de"]
    assert got[3].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got)
    empty = fit(df.limit(0))
    assert empty.langs == [] and predict(empty, ["some text"])[0] == ["und"]
    assert identify(df.limit(0), model).count() == 0


def test_held_out_accuracy_and_split(spark):
    from postresp.llm.queries import op8_language_id
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op8_language_id(spark, sf).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r.held_out and r.lang is not None]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.95


def test_prediction_ignores_label_source_and_id(spark):
    rows = [(i * 3 + k, t, lang) for i in range(20) for k, (lang, t) in enumerate(SAMPLES.items())]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    a = identify(spark.createDataFrame([(1, SAMPLES["en"], "fr")], "doc_id long, text string, lang string"), model).collect()
    b = identify(spark.createDataFrame([(2, SAMPLES["en"], "de")], "doc_id long, text string, lang string"), model).collect()
    assert (a[0].lang_pred, a[0].score) == (b[0].lang_pred, b[0].score)
