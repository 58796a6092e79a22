import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from postresp.llm.oracles import OP10
from postresp.llm.quality_rules import Rules, common_lines, quality_filter, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, rules):
    """Expected rows of (doc_id, text, source) triples, and the texts left."""
    holders, hosts, rows = defaultdict(set), Counter(s for _, s in {(t, s) for _, t, s in docs}), []
    norm = lambda line: " ".join(WORD.findall(line.translate(LOWER)))
    for _, text, s in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[s, norm(line)].add(text)
    for i, text, s in docs:
        text_ = text or ""
        words, lines = WORD.findall(text_), text_.split("\n")
        seen, dup = set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        many = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if many[w] >= 2 for j in range(3)}
        limit = max(rules.min_line_docs, rules.max_line_share * hosts[s])
        bad = [bool(WORD.search(x)) and len(holders[s, norm(x)]) > limit for x in lines]
        removed = sum(len(WORD.findall(x)) for x, b in zip(lines, bad) if b)
        n = len(words)
        failed = n < rules.min_words or 100 * len(covered) > rules.max_repeat_percent * n
        kept = not failed and n - removed >= rules.min_left_share * n
        left = None if text is None else "\n".join(x for x, b in zip(lines, bad) if not b)
        rows.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text_), dup, len(covered), removed, failed, kept, left))
    return rows


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "removed_words", "base_failed", "kept")) for r in df.collect()), key=repr)


def fixture():
    body = lambda k, n=60: " ".join(f"w{k}x{j}é" for j in range(n))
    docs = [(k, f"{body(k)}\nCommon  LINE here\n\n common line\there \nx#{k}", "a") for k in range(12)]
    docs += [(100 + k, "copy of one text " + body(7000), "a") for k in range(9)]
    docs += [(200 + k, f"tiny {k}\n" + "shared part " * 2 + body("same", 200), "b") for k in range(8)]
    docs += [(300, None, "a"), (301, "", None), (302, " \n\t", None), (303, "a b c a b c a b c " * 9, None), (304, body(1), None),
             (305, "word " * 60000, "b"), (306, "Common line here\n" * 30 + body(5), "zz"), (7, docs[7][1], "a"), (None, body(9), "b")]
    return docs


@pytest.mark.parametrize("rules", [Rules(min_line_docs=5, max_line_share=0.2), Rules(),
                                   Rules(min_line_docs=5, max_line_share=0.2, max_broadcast_lines=0)])
def test_equals_brute_force(spark, rules):
    docs = fixture()
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, source string, kept string, key string")
    expected = brute(docs, rules)
    assert as_rows(quality_rules(df.repartition(5), rules)) == sorted((r[:-1] for r in expected), key=repr)
    left = sorted(((r.doc_id, r.text, r.kept) for r in quality_filter(df.repartition(3), rules).collect()), key=repr)
    assert left == sorted(((r[0], r[-1], "x") for r in expected if r[-2]), key=repr)


def test_common_lines_are_counted_by_different_texts(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string, source string")
    rows = common_lines(df, Rules(min_line_docs=5, max_line_share=0.0)).collect()
    assert sorted(r.n_docs for r in rows) == [8, 12]   # the line in all of host a, the shared passage of host b


def test_query_equals_brute_force(spark):
    from postresp.llm.queries import op10_quality_rules
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert as_rows(op10_quality_rules(spark, sf)) == sorted((r[:-1] for r in brute(docs, Rules())), key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules(df).count() == 0 and quality_filter(df).count() == 0


def test_copies_do_not_raise_the_limit_of_their_host(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    docs = [(k, f"{body(k)}\n" + ("cookie notice of the host" if k < 45 else f"own {k}"), "a") for k in range(100)]
    docs += [(1000 + k, body(-1), "a") for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert [r.n_docs for r in common_lines(df).collect()] == [45]     # of 101 different texts, in 1000 rows
    expected = sorted((r[:-1] for r in brute(docs, Rules())), key=repr)
    assert as_rows(quality_rules(df)) == expected
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*docs))))))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({OP10})").fetchall(), key=repr) == expected
    rows = quality_rules(df).collect()
    assert sum(r.removed_words == 5 for r in rows) == 45 and sum(r.removed_words for r in rows) == 225
    left = quality_filter(df.repartition(3)).collect()
    assert len(left) == 1000 and not any("cookie notice" in r.text for r in left)
