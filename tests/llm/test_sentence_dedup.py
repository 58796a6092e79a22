import hashlib
import random
import re

import pytest

from postresp.llm import sentence_dedup
from postresp.llm.sentence_dedup import SENTENCES, WORDS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    """(start of the first word, words) of each sentence."""
    out, now, begin, end = [], [], None, 0
    for m in WORD.finditer(text):
        if now and (now[-1][-1] in ".!?" or "\n" in text[end:m.start()]):
            out.append((begin, now))
            now = []
        begin = begin if now else m.start()
        now.append(m[0].translate(LOWER))
        end = m.end()
    return out + [(begin, now)] if now else out


def runs(sentences):
    found, n = set(), len(sentences)
    size = lambda a, b: sum(len(s[1]) for s in sentences[a:b + 1])
    for s in range(n):
        found |= {(s, b) for b in [next((b for b in range(s + SENTENCES - 1, n) if size(s, b) >= WORDS), None)] if b is not None}
        found |= {(a, s) for a in [next((a for a in range(s - SENTENCES + 1, -1, -1) if size(a, s) >= WORDS), None)] if a is not None}
    return sorted(found)


def brute(rows, order):
    seen, gone = {}, {}
    every = {}
    for k in order:
        sentences = split(rows[k][1] or "")
        for a, b in runs(sentences):
            key = tuple(w for s in sentences[a:b + 1] for w in s[1])
            every.setdefault(key, []).append((k, a, b))
    for places in every.values():
        places.sort(key=lambda p: (order.index(p[0]), p[1], p[2]))
        for k, a, b in places[1:]:
            gone.setdefault(k, set()).update(range(a, b + 1))
    out = []
    for k in order:
        text = rows[k][1] or ""
        sentences = split(text)
        edges = [s[0] for s in sentences] + [len(text)]
        lost = gone.get(k, set())
        kept = text if not lost else text[:edges[0]] + "".join(text[edges[i]:edges[i + 1]] for i in range(len(sentences)) if i not in lost)
        out.append((rows[k][0], len(sentences), len(lost), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert not seen
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_sentences", "n_removed", "kept_sha256", "text")) for r in df.collect()), key=repr)


def corpus(seed):
    r = random.Random(seed)
    sentence = lambda: " ".join("".join(r.choices("abcdeéF", k=r.randint(1, 6))) for _ in range(r.randint(1, 14))) + r.choice([".", "!", "?", "", "..."])
    passages = [" ".join(sentence() for _ in range(r.randint(2, 9))) for _ in range(6)]
    rows = []
    for k in range(70):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts += [" ".join(sentence() for _ in range(r.randint(0, 4))), r.choice(passages) if r.random() < 0.6 else sentence()]
        rows.append((k * 2, r.choice(["\n", " ", "\n\n"]).join(parts)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "one."), (904, "Same words. " * 40), (905, "x " * 30000 + ". y."),
             (906, rows[5][1].upper()), (907, rows[5][1]), (None, rows[6][1]), (908, "no end of sentence " * 10)]
    return rows


@pytest.mark.parametrize("seed,local", [(1, 1 << 18), (2, 10)])
def test_equals_brute_force(spark, monkeypatch, seed, local):
    monkeypatch.setattr(sentence_dedup, "LOCAL", local)
    rows = corpus(seed)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, spans string, n_removed int").repartition(5)
    assert as_rows(sentence_dedup.sentence_dedup(df)) == brute(rows, order)


def test_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten. " * 1 + "a b c d e f g h i j k. l m."
    df = spark.createDataFrame([(1, text), (1, text), (2, "short one. two.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sentence_dedup.sentence_dedup(df).collect())
    assert got == [(1, 0), (1, 3), (2, 0)]


def test_query_equals_brute_force(spark):
    from postresp.llm.queries import op3_sentence_spans
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    got = as_rows(op3_sentence_spans(spark, sf))
    assert got == brute(rows, order) and any(r[2] for r in got)


def test_empty_table(spark):
    assert sentence_dedup.sentence_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_runs_are_found_whatever_stands_around_them(spark):
    rows = [(1, "Alpha one two three four five six seven eight. Yes, go. No, stay! Beta nine ten eleven twelve."),
            (2, "Gamma is other here. Yes, go. No, stay! Delta differs as well."),
            (3, "Epsilon. Yes, go. Zeta. No, stay!"),
            (4, "Eta a b. Theta c d. Iota e f. Kappa g h."),
            (5, "Lambda.\nTheta c d. Iota e f. Kappa g h.\nMu.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.text) for r in sentence_dedup.sentence_dedup(df, words=1).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "Gamma is other here. Delta differs as well."), 3: (0, rows[2][1]),
                   4: (0, rows[3][1]), 5: (3, "Lambda.\nMu.")}


def test_runs_go_on_until_they_have_enough_words(spark):
    shared = "Oh, yes. Go on! It was said before by all of them."
    rows = [(1, "First it stands here alone. " + shared + " Then more of it."),
            (2, "Oh, yes. Go on! Nothing else is known of this one."),
            (3, "Some other text here. " + shared + " And its end."),
            (4, "Ah. So. " * 3), (5, "Ah. So. " * 3 + "The rest differs from that.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.text) for r in sentence_dedup.sentence_dedup(df).collect()}
    assert got == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (3, "Some other text here. And its end."),
                   4: (0, rows[3][1]), 5: (0, rows[4][1])}
