import random
import re

import pytest
from pyspark.sql import functions as F

from postresp.llm import near_dup
from postresp.llm.graph import components
from postresp.llm.near_dup import deduplicated, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """{doc_id: (sizes of its rows, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), (find(i) if s else i) if i is not None else None) for i, s in sets), key=repr)


def as_rows(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: r.choices(vocabulary, k=n)
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n * 7 % 100003, " ".join(words)))
        n += 1

    for _ in range(15):                      # groups of edited copies around a base
        base = text(r.randint(60, 200))
        group = r.randint(1, 12)
        for _ in range(group):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            add(words)
    passage = text(60)
    for _ in range(40):                      # a shared passage, not near copies
        add(text(r.randint(20, 150)) + passage)
    for _ in range(30):
        add(text(r.randint(1, 120)))
    rows += [(200001, None), (200002, ""), (200003, " \n\t"), (200004, "a b"), (200005, "A  B"), (200006, "a b c d"), (200007, "word " * 50000),
             (200008, "WORD " * 300), (None, "a b"), (None, None), (200009, rows[0][1]), (200009, rows[0][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:                                # many units, joined rather than broadcast
        monkeypatch.setattr(near_dup, "MEMBERS", 3)
        monkeypatch.setattr(near_dup, "BLOCK", 2)
        monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    rows = corpus(2 if small else 1)
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, component_id string, doc int").repartition(5)
    assert as_rows(near_duplicates(df)) == brute(rows)


def test_links_that_no_hub_has(spark):
    """Copies that link with their base or one another, but not all with one."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for i in r.sample(range(100), 3):
            words[i] = f"x{k}_{i}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(near_duplicates(df)) == brute(rows)


def survivors(rows):
    """Ids that stay (with how many rows), by comparing all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for (i, _), s, g in zip(rows, sets, group):
        if s:
            best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return sorted(([None if none else i for none, i in best.values()] + [i for (i, _), s in zip(rows, sets) if not s]), key=repr)


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, row string, node int")
    got = deduplicated(df.repartition(5))
    assert got.columns == df.columns
    got = got.collect()
    assert sorted((r.doc_id for r in got), key=repr) == survivors(rows) and {(r.doc_id, r.text) for r in got} <= set(rows)


def test_shared_and_missing_ids_lose_no_unrelated_text(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    near = text(1) + " and one more"
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (5, near), (None, text(3)), (None, text(3)), (7, text(3)), (None, text(4)), (None, near),
            (9, None), (9, None), (9, "")]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, text(1)), (1, text(2)), (7, text(3)), (None, text(4)), *rows[9:]], key=repr)


def test_query_equals_brute_force(spark):
    from postresp.llm.queries import op7_near_duplicates
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(op7_near_duplicates(spark, sf)) == brute(rows)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 300: 300, 301: 300, 302: 300}
    assert components(df.where(F.lit(False))).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and deduplicated(df).count() == 0


def test_unique_ids_name_the_rows(spark):
    rows = [(i, t) for i, t in {i: t for i, t in corpus(3)}.items() if i is not None]
    df = spark.createDataFrame([(t, i, 5) for i, t in rows], "text string, doc_id int, node string")
    got = deduplicated(df.repartition(4))
    assert got.dtypes == df.dtypes and sorted((r.doc_id for r in got.collect()), key=repr) == survivors(rows)


@pytest.mark.parametrize(("last", "tables"), [(3, ["copies"]), (2, ["copies", "numbered-documents"])])
def test_dedup_leaves_only_the_tables_its_result_reads(spark, last, tables):
    import os

    from postresp.session import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text), (2, text + " eleven"), (last, "other words stand here")], "doc_id long, text string")
    got = sorted(r.doc_id for r in near_dup.deduplicated(df).collect())
    new = sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before)
    assert got == [1, last] and new == tables
