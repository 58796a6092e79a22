import hashlib
import random

import numpy as np
import pytest

from postresp.llm import suffix_dedup
from postresp.llm.repeats import anchored_repeats, common_prefix, intervals, suffix_array
from postresp.llm.suffix_dedup import blocks, cut_texts, dedup_digests

W = 100


def brute(rows, window=W):
    """Expected digests: a dictionary of all windows in order of their places."""
    seen, out = {}, []
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    hashes = [r[0] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("xxhash64(t)").collect()]
    clash = len({i for i, _ in rows}) < len(rows)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashes[k] if clash else 0))
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - window + 1):
            if raw[s:s + window] in seen:
                gone[s:s + window] = True
            else:
                seen[raw[s:s + window]] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((rows[k][0], len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=repr)


def corpus(seed, ids=True):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(5, 60)) for _ in range(8)]
    rows = []
    for k in range(80):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [text(r.randint(0, 15)), p[a:r.randint(a, len(p))] if r.random() < 0.5 else p]
        rows.append((k * 3, "\n".join(parts)))
    base = rows[10][1] + text(80)
    for k in range(25):
        at = r.randrange(len(base) - 10)
        rows.append((1000 + k, base[:at] + word() + base[at + 5:]))
    rows += [(2000, None), (2001, ""), (2002, "x" * 99), (2003, "x" * 100), (2004, "x" * 450), (2005, "ab" * 300), (2006, "word " * 400),
             (2007, base), (2008, base), (2009, "a\x00b\x00" * 60), (2010, base[7:])]
    if not ids:
        rows += [(2007, base), (2007, "other text under one id " + base[:150]), (None, base[3:]), (None, "z" * 300), (2003, "x" * 100)]
    return rows


@pytest.mark.parametrize("seed,group,piece,ids", [(1, 20_000, 4 << 20, True), (2, 1, 4 << 20, True), (3, 20_000, 300, False), (4, 2, 4 << 20, False)])
def test_equals_brute_force(spark, monkeypatch, seed, group, piece, ids):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = corpus(seed, ids)
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, spans string, start int").repartition(6)
    assert as_rows(dedup_digests(df)) == brute(rows)


def test_cut_texts_keeps_columns(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "e", 1, 7) for i, t in rows], "doc_id long, text string, row string, n_chars int, copy int")
    got = {r.doc_id: r for r in cut_texts(df.repartition(3)).collect()}
    digest = {r[0]: r for r in brute(rows)}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.row, r.copy) == ("e", 7) and (r.text is None) == (t is None)
        if t is not None:
            assert r.n_chars == len(r.text)
            if "é" not in t:
                assert hashlib.sha256(r.text.encode()).hexdigest() == digest[i][4]
    assert got[2008].text == "" and got[2002].text == "x" * 99


def test_every_window_has_one_owner_with_equal_place():
    r = random.Random(3)
    common = bytes(r.choices(b"abcd", k=400))
    texts = [bytes(r.choices(b"abcd", k=r.randint(0, 300))) + common + bytes(r.choices(b"abcd", k=r.randint(0, 300))) for _ in range(5)] + [b"", b"x" * 99]
    b = blocks(texts)
    owned = {}
    for t, s, e, a, g in zip(b["text"], b["start"], b["end"], b["anchor"], b["gram"]):
        for w in range(s, e - W + 1):
            assert (t, w) not in owned
            owned[t, w] = (s + a - w, g)
    assert set(owned) == {(t, w) for t, x in enumerate(texts) for w in range(len(x) - W + 1)}
    places = {}
    for (t, w), own in owned.items():
        assert places.setdefault(texts[t][w:w + W], own) == own


def brute_repeats(lefts, rights, least):
    """Maximal groups of members that share a stretch around the anchor."""
    n, out = len(lefts), set()
    for i in range(n):
        for j in range(n):
            if i == j:
                continue
            left, right = common_prefix(lefts[i], lefts[j]), common_prefix(rights[i], rights[j])
            for a, b in ((left, right),):
                if a + b < least:
                    continue
                group = [k for k in range(n) if lefts[k][:a] == lefts[i][:a] and rights[k][:b] == rights[i][:b] and len(lefts[k]) >= a and len(rights[k]) >= b]
                deep = min(common_prefix(lefts[group[0]], lefts[k]) for k in group)
                far = min(common_prefix(rights[group[0]], rights[k]) for k in group)
                out.add((deep, far, tuple(sorted(group))))
    return out


def test_maximal_repeats_equal_brute_force():
    r = random.Random(4)
    for _ in range(200):
        n, k = r.randint(2, 9), r.choice(["ab", "abc"])
        word = lambda: "".join(r.choices(k, k=r.randint(0, 7))).encode()  # noqa: E731, B023
        lefts, rights = [word() for _ in range(n)], [word() for _ in range(n)]
        least = r.randint(1, 6)
        got = {(a, b, tuple(sorted(g))) for a, b, g in anchored_repeats(lefts, rights, least)}
        assert brute_repeats(lefts, rights, least) <= got
        for a, b, g in got:
            assert a + b >= least and len({lefts[i][:a] for i in g}) == 1 and len({rights[i][:b] for i in g}) == 1
            assert all(len(lefts[i]) >= a and len(rights[i]) >= b for i in g)


def test_common_prefix_intervals_are_those_of_the_definition():
    r = random.Random(6)
    for _ in range(100):
        words = sorted("".join(r.choices("ab", k=r.randint(0, 6))).encode() for _ in range(r.randint(1, 10)))
        order, lcp = suffix_array(words)
        got = {(a, b, d) for a, b, d, _ in intervals(lcp, 1)}
        expected = set()
        for a in range(len(words)):
            for b in range(a + 1, len(words)):
                d = min(lcp[a + 1:b + 1])
                if d >= 1 and (a == 0 or lcp[a] < d) and (b + 1 == len(words) or lcp[b + 1] < d):
                    expected.add((a, b, d))
        assert got == expected and [words[i] for i in order] == words


def test_query_equals_brute_force(spark):
    from postresp.llm.queries import op1_suffix_dedup
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(op1_suffix_dedup(spark, sf)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_digests(df).count() == 0 and cut_texts(df).count() == 0
