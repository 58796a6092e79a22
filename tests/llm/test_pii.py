import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from postresp.llm import pii as P
from postresp.llm.common import text_bytes

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def rules_brute(text):
    out = []
    for order, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_rules_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "B.c", "@", "@@", ".", "-", "+1", "+", " ", "(555)", "192.168.0.1", "300.1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111111", "٣", "é",
             "x@y.org", "x@y", "00000001.2.3.4", "\n", "7", "123-456", "555-0100", "@a.b", "%", "a@b.c@d.e"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert P.base_spans(text) == rules_brute(text), text
    long = "a" * 200000 + " " + "1" * 200000 + "." * 50000 + "+1" + "(" * 50000
    assert P.base_spans(long) == []


@pytest.fixture(scope="module")
def field(spark):
    return P.fit_table(P.labelled_table(spark))


def random_field(rng):
    may_move, may_start = P._allowed()
    f = P.Field(rng.normal(size=(2 * P.REACH + 1, P.N_SHAPES, P.N_LABELS)).astype(np.float32), rng.normal(size=(P.N_LABELS,) * 2), rng.normal(size=P.N_LABELS))
    f.move[~may_move] = f.start[~may_start] = -np.inf
    return f


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(6):
        f = random_field(rng)
        sizes = rng.integers(1, 5, 4)
        lines = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scores = rng.normal(size=(sizes.sum(), P.N_LABELS))
        got = P.viterbi(f, scores, lines)
        for a, n in zip(lines, sizes):
            value = lambda y: f.start[y[0]] + sum(f.move[p, q] for p, q in zip(y, y[1:])) + sum(scores[a + i, c] for i, c in enumerate(y))  # noqa: E731, B023
            best = max(itertools.product(range(P.N_LABELS), repeat=int(n)), key=value)
            assert tuple(got[a:a + n]) == best


def test_lines_passed_over_have_no_spans(spark, field):
    rng = np.random.default_rng(4)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    raw, offsets = text_bytes(pa.array(texts))
    t = P.Tokens(raw, offsets)
    fields = [field] + [random_field(rng) for _ in range(3)]
    fields[1].shape[:, :, 0] += 1.5          # some of either kind
    fields[2].shape[:, :, 0] += 2.5
    for f in fields:
        scores = f.scores(t.shape, t.line)
        live = f.live_lines(scores, t.lines)
        assert not P.viterbi(f, scores, t.lines)[~live[t.line]].any()
    live = field.live_lines(field.scores(t.shape, t.line), t.lines)
    assert 0 < live.sum() < len(live)


def test_gradient_equals_finite_differences(monkeypatch):
    """One step of plain ascent moves the weights along the likelihood's gradient."""
    rows = [("call +1 5", [(5, 9, "phone")]), ("a b", []), ("key x9 y", [(4, 6, "key")])]
    raw, offsets = text_bytes(pa.array([s for s, _ in rows]))
    t = P.Tokens(raw, offsets)
    gold = [[0, 7, 8, 8], [0, 0], [0, 9, 0]]
    may_move, may_start = P._allowed()

    def likelihood(f):
        scores, total = f.scores(t.shape, t.line).astype(float), 0.0
        move, start = np.where(may_move, f.move, -1e9), np.where(may_start, f.start, -1e9)
        for a, y in zip(t.lines, gold):
            own = start[y[0]] + sum(move[p, q] for p, q in zip(y, y[1:])) + sum(scores[a + i, c] for i, c in enumerate(y))
            ahead = start + scores[a]
            for i in range(1, len(y)):
                ahead = np.logaddexp.reduce(ahead[:, None] + move, axis=0) + scores[a + i]
            total += own - np.logaddexp.reduce(ahead)
        return total

    f = P.fit(rows, steps=40, penalty=0.0)
    f.shape = f.shape.astype(float)
    f.move[~may_move] = f.start[~may_start] = 0.0
    better = likelihood(f)
    zero = P.Field(np.zeros_like(f.shape), np.zeros_like(f.move), np.zeros_like(f.start))
    assert better > -0.2 and likelihood(zero) < -10
    g = P.fit(rows, steps=1, rate=1e-4, penalty=0.0)          # Adam's first step: the gradient's signs
    for d, c, y in [(2, t.shape[1], 7), (2, t.shape[1], 0), (1, t.shape[0], 9), (3, t.shape[2], 8)]:
        step = P.Field(np.zeros_like(f.shape), np.zeros_like(f.move), np.zeros_like(f.start))
        step.shape[d, c, y] = 1e-4
        slope = likelihood(step) - likelihood(zero)
        assert np.sign(g.shape[d, c, y]) == np.sign(slope) and abs(slope) > 1e-9
    step = P.Field(np.zeros_like(f.shape), np.zeros_like(f.move), np.zeros_like(f.start))
    step.move[7, 8] = 1e-4
    assert np.sign(g.move[7, 8]) == np.sign(likelihood(step) - likelihood(zero)) == 1


def test_held_out_sentences(spark, field):
    rows = [(r.sentence, {tuple(s) for s in r.spans}) for r in P.labelled_table(spark, copies=6, seed=99).collect()]
    found = P._added(field, pa.array([s for s, _ in rows]))
    got = [{(s, e, P.KINDS[k]) for s, e, k in found.get(i, [])} for i in range(len(rows))]
    both = sum(len(g & w) for g, (_, w) in zip(got, rows))
    assert both >= 0.97 * sum(len(w) for _, w in rows) and both >= 0.97 * sum(map(len, got))


def shape_of(token, blank):
    code = P._CODE
    n, text = len(token), token.decode("latin-1")
    digits, low = sum(c in "0123456789" for c in text), sum("a" <= c <= "z" or c >= "\x80" for c in text)
    up = n - digits - low
    if not P._IS_WORD[token[0]]:
        name = f"sign {text}" if text in P._SIGNS else "other"
    elif digits == n:
        name = next(f"{k} digits" for m, k in ((1, "1"), (2, "2"), (3, "3"), (4, "4"), (6, "5-6"), (8, "7-8"), (11, "9-11"), (19, "12-19"), (10**9, "20+")) if n <= m)
    elif digits:
        name = ("hex" if n >= 16 and re.fullmatch("[0-9a-fA-F]+", text) else "code" if n >= 12 else "1mix" if text[0] in "0123456789" else "word1")
    elif n < 10 and text.translate({k: k + 32 for k in range(65, 91)}) in P._CUES:
        name = "cue " + text.lower()
    else:
        name = ("long" if n > 30 else "letter" if n == 1 else "Capital" if up == 1 and text[0].isascii() and text[0].isupper() else "UPPER" if up == n
                else "lower" if low == n else "miXed")
    return 2 * code[name] + blank


def brute_spans(field, text):
    """Rules and field by plain loops, line by line."""
    rules, out = rules_brute(text), []
    base = 0
    for line in text.encode().split(b"\n"):
        tokens = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^ \t\n\x0b\x0c\r0-9A-Za-z\x80-\xff]", line)]
        shapes = [shape_of(line[s:e], int(k == 0 or s > tokens[k - 1][1])) for k, (s, e) in enumerate(tokens)]
        way, best = [], None
        for k in range(len(tokens)):
            score = sum(field.shape[d + P.REACH][shapes[k + d] if 0 <= k + d < len(shapes) else 0] for d in range(-P.REACH, P.REACH + 1))
            if best is None:
                best = field.start + score
            else:
                ways = best[:, None] + field.move
                way.append(ways.argmax(0))
                best = ways.max(0) + score
        if best is not None:
            y = [int(best.argmax())]
            for step in reversed(way):
                y.append(int(step[y[-1]]))
            y = y[::-1] + [0]
            for k, label in enumerate(y):
                if label % 2:
                    last = k
                    while y[last + 1] == label + 1:
                        last += 1
                    s, e = (len(line[:x].decode()) + base for x in (tokens[k][0], tokens[last][1]))
                    out.append((s, (label - 1) // 2, e))
        base += len(line.decode()) + 1
    every = [(s, P.KINDS.index(k), e, True) for s, e, k in rules]
    every += [(s, k, e, False) for s, k, e in out if not any(s < b and a < e for a, b, _ in rules) and P.plausible(P.KINDS[k], text[s:e])]
    return sorted(every)


def test_query_equals_plain_loops(spark, field):
    from postresp.llm.queries import op13_pii
    sf = "/root/testdata/sf0.001"
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        spans = brute_spans(field, r.text or "")
        base = [x for x in spans if x[3]]
        line = lambda xs: ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e, _ in xs)
        expected.append((r.doc_id, *[sum(P.KINDS[k] == kind for _, k, _, _ in base) for kind in P.BASE_KINDS],
                         hashlib.sha256(line(base).encode()).hexdigest(), line(spans)))
    got = op13_pii(spark, sf).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert any(":" in r.spans for r in got)


def test_edge_cases(spark, field):
    texts = [None, "", " \n\t", "é" * 9 + " mail anna.b@mail.example.org\nTel. (555) 123-4567, now é", "no data here. " * 2000, "+1 555 123 4567 " * 300,
             "x" * 3000, 'token = "0123456789abcdef0123456789abcdef"', "write to anna at mail dot org"]
    rows = [(k, t, "s", "m") for k, t in enumerate(texts)] + [(3, texts[3], "s", "m"), (None, texts[3], "s", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, masked string").repartition(4)
    got = sorted(((r.doc_id, [(s.start, P.KINDS.index(s.kind), s.end, s.base) for s in r.spans], r.masked) for r in P.personal_data(df, field).collect()), key=repr)
    expected = sorted(((k, brute_spans(field, t or ""), P._mask(t, brute_spans(field, t or ""))) for k, t, *_ in rows), key=repr)
    assert got == expected
    by = {k: (s, m) for k, s, m in got}
    assert by[0] == ([], None) and by[1] == ([], "") and by[4][0] == []
    assert by[3][1] == "é" * 9 + " mail [email]\nTel. [phone], now é" and by[7][1] == 'token = "[key]"' and by[8][1] == "write to [email]"


def test_empty_table(spark, field):
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string"), field).count() == 0


def test_labelled_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_LABELLED", 7)
    seen = []
    monkeypatch.setattr(P, "fit", lambda rows, **how: seen.extend(rows))
    P.fit_table(P.labelled_table(spark, copies=2))
    assert len(seen) == 7
