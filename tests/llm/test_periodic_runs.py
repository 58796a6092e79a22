import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from postresp.llm.periodic_runs import find_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_words=12):
    """All runs by trying every period: stretches of equal words ``q`` apart."""
    runs, n = set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_words, 2 * q):
                # the smallest period only
                if not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                    runs.add((i, length, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def random_words(rng):
    n, letters = rng.randrange(0, 90), rng.choice([1, 2, 3, 8])
    words = [rng.choice("abcdefgh"[:letters]) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        unit = words[: rng.randrange(1, 9)]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (unit * 9)[: rng.randrange(40)]
    return words


@pytest.mark.parametrize("min_words", [2, 5, 12, 13])
def test_find_runs_equals_brute_force(min_words):
    rng = random.Random(min_words)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        symbols = np.array([k * 100 + ord(w) for k, t in enumerate(texts) for w in t], np.int64)
        start, length, period = find_runs(symbols, offsets, min_words)
        expected = [(offsets[k] + s, n, q) for k, t in enumerate(texts) for s, n, q in brute(t, min_words)]
        assert sorted(zip(start, length, period)) == sorted(expected)


def test_rows_and_edge_cases(spark):
    rng = random.Random(1)
    texts = [" ".join(random_words(rng)) for _ in range(60)]
    texts += [None, "", " \t\r\n\x0b\x0c", "é\xa0é " * 40, "word " * 60000, "a b c\n" * 5000 + "x\x85y z " * 9, "x" * 300000]
    rows = [(k, t, "r", 1) for k, t in enumerate(texts)] + [(3, texts[3], "r", 1), (None, "ab cd " * 9, "r", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=repr)
    expected = []
    for k, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = ([(0, 60000, 1)] if t == "word " * 60000 else brute_long(words) if len(words) > 5000 else brute(words))
        expected.append((k, len(words), runs, collapsed(words, runs)))
    assert got == sorted(expected, key=repr)


def brute_long(words):
    assert words[:15000] == ["a", "b", "c"] * 5000
    return [(0, 15000, 3)] + [(s + 15000, n, q) for s, n, q in brute(words[15000:])]


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    from postresp.llm.queries import op12_periodic_runs
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = planted(r.doc_id, WORD.findall(r.text or ""))
        runs = long_brute(words)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        expected.append((r.doc_id, len(runs), s, n, q, 1000 * n // q if runs else None,
                         sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs))))
    got = op12_periodic_runs(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                               "collapsed_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert sum(r.n_runs > 0 for r in got) > 10


def long_brute(words):
    """``brute`` with stretches of equal words found by numpy."""
    _, ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0, int))
    runs, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]])
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            length = int(j - i + q)
            # periods in ascending order: the first to cover a stretch is its smallest
            if length >= max(12, 2 * q) and not any(s <= i and i + length <= s + m for s, m, _ in runs.values()):
                runs[int(i), q] = (int(i), length, q)
    return sorted(runs.values(), key=lambda r: (r[0], r[2]))
