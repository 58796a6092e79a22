import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from postresp.llm import mixing
from postresp.llm.common import mix64
from postresp.llm.mixing import Mix, _cut, dealt, even, mix_sources, mixed_texts, permuted, shard_plan, taken_words, with_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def docs():
    r = random.Random(3)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(r.randint(0, 300))), "big" if i % 3 else f"s{i % 4}é") for i in range(400)]
    rows += [(1000, None, "big"), (1001, "", None), (1002, " \n", "empty"), (1003, "long " * 40000, "z"), (1004, "a b c", None),
             (None, "no id here", "big"), (7, "x y", "big"), (7, "x y", "big")]
    return rows


def frame(spark, rows, n=4):
    return spark.createDataFrame([(*r, "e", 0) for r in rows], "doc_id long, text string, source string, size string, n_chars int").repartition(n)


def targets(sizes, mix=Mix()):
    """The sharing by hand: full sources leave, the rest is shared again."""
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    caps = [mix.most * s for s in sizes]
    total, out = min(mix.share * sum(sizes), sum(caps)), [0.0] * len(sizes)
    open_ = [i for i, c in enumerate(caps) if c]
    while open_:
        rate = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rate >= caps[i]]
        for i in full or open_:
            out[i] = float(caps[i]) if full else weights[i] * rate
        total -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


@pytest.mark.parametrize("sizes,mix", [([100, 1000, 1000, 10, 0], Mix()), ([5, 5], Mix(share=9)), ([0], Mix()), ([], Mix()),
                                       ([0, 0, 7], Mix()), ([2 ** k for k in range(40)], Mix(share=1.9)), ([3] * 50 + [900] * 3, Mix())])
def test_targets_are_shared_by_weight_and_stopped(spark, sizes, mix):
    df = spark.createDataFrame(list(enumerate(sizes)), "number long, source_size long")
    got = [r.target for r in with_targets(df, mix).orderBy("number").collect()]
    assert got == pytest.approx(targets(sizes, mix), rel=1e-12)
    assert sum(got) == pytest.approx(min(mix.share * sum(sizes), mix.most * sum(sizes)))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    a = permuted(np.arange(n), n, 5)
    assert sorted(a) == list(range(n))
    if n > 100:
        assert (a != permuted(np.arange(n), n, 6)).any() and (a != np.arange(n)).mean() > 0.9


def test_dealt_counts_meet_the_quotas():
    wanted = even(1343, 16)
    counts = dealt(np.array([1000, 10, 0, 333]), wanted, np.random.default_rng(1))
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 333] and counts.sum(axis=1).tolist() == wanted and np.ptp(wanted) <= 1
    assert dealt(np.zeros(1, int), even(0, 4), np.random.default_rng(1)).sum() == 0 and sum(even(3, 7)) == 3


@pytest.mark.parametrize("fan,n", [(1024, 60), (4, 60), (4, 4), (7, 1)])
def test_shard_plan_over_levels(spark, monkeypatch, fan, n):
    """Any number of levels fills every shard without gaps and meets the quotas."""
    monkeypatch.setattr(mixing, "FAN", fan)
    r = random.Random(fan)
    quota = {i: r.choice([0, 1, 5, 40, 300]) for i in range(n)}
    df = spark.createDataFrame([(i, q, 9) for i, q in quota.items()], "number long, quota long, blocks long").repartition(3)
    got = shard_plan(df, n, Mix(shards=8)).collect()
    by, shards = defaultdict(list), defaultdict(list)
    for x in got:
        by[x.number].append((x.shard, x.first, x.slots))
        shards[x.shard].append((x.place, x.slots))
    assert {i: sum(c[2] for c in v) for i, v in by.items()} == {i: q for i, q in quota.items() if q}
    for v in [*shards.values(), *[[c[1:] for c in sorted(v)] for v in by.values()]]:
        end = 0
        for begin, slots in sorted(v):
            assert begin == end and slots > 0
            end += slots
    sizes = sorted(sum(c[1] for c in shards[h]) for h in range(8))
    assert sizes[-1] - sizes[0] <= 1


def plain_mix(rows, mix):
    """Words taken per (id, text) by plain loops over streams, quotas, draws and permutations."""
    import xxhash
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, t or "", s) for i, t, s in rows]
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    content = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())

    def chunk(i, t):
        seed = 42 if i is None else xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()
        return signed(xxhash.xxh64(content(t).to_bytes(8, "little", signed=True), seed=seed).intdigest()) % mixing.CHUNKS

    want = targets([sum(size(t) for _, t, s in rows if s == o) for o in order], mix)
    n_blocks, quotas, streams = [], [], []
    for o, target in zip(order, want):
        own = sorted((r for r in rows if r[2] == o), key=lambda r: (chunk(*r[:2]), r[0] is not None, r[0] or 0, content(r[1])))
        stream = [(i, t) for i, t, _ in own for _ in range(size(t))]
        streams.append(stream)
        n_blocks.append(-(-len(stream) // mix.block))
        quotas.append(round(target * n_blocks[-1] / len(stream)) if stream else 0)
    taken = Counter()
    for number, (stream, n, quota) in enumerate(zip(streams, n_blocks, quotas)):
        for slot in range(quota):          # whatever shard it is dealt to, the source's slots are 0 .. quota - 1
            key = int(mix64(np.array([mix.seed * 0x9E3779B1 + number * 0x10001 + slot // n * 0x100000001], np.uint64))[0])
            block = int(permuted(np.array([slot % n]), n, key)[0])
            taken.update(stream[block * mix.block:(block + 1) * mix.block])
    return taken


def test_equals_a_plain_mix(spark):
    rows, mix = docs(), Mix(block=16, shards=8)
    mixed, _ = mix_sources(frame(spark, rows), mix)
    got = Counter()
    names = {}
    import xxhash
    for i, t, _ in rows:
        names[i, xxhash.xxh64((t or "").encode(), seed=42).intdigest()] = t or ""
    for r in mixed.collect():
        got[r.doc_id, names[r.doc_id, r.content % (1 << 64)]] += r.n_words
    assert got == plain_mix(rows, mix)


def test_many_sources_and_copies(spark, monkeypatch):
    """More sources than a task deals to, and a third of all rows copies of one text without an id."""
    monkeypatch.setattr(mixing, "FAN", 8)
    rows = [(i, "w " * (i % 40), f"host{i}") for i in range(300)] + [(None, "same text without an id", "hot")] * 150
    mix = Mix(block=4, shards=8)
    got = taken_words(frame(spark, rows), mix).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), rel=0.02)
    left = [r for r in mixed_texts(frame(spark, rows), mix).collect() if r.source == "hot"]
    assert len(left) == 1 and left[0].text.startswith("same text")


def test_taken_words_meet_the_targets(spark):
    rows, mix = docs(), Mix(block=16, shards=8)
    got = taken_words(frame(spark, rows), mix).collect()
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=repr) == sorted(((i, size(t), s) for i, t, s in rows), key=repr)
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([sizes[s] for s in order], mix)))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(2 * mix.block, 0.03 * want[s])


def test_reruns_agree(spark):
    rows, mix = docs(), Mix(block=16, shards=8)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    a, b = taken_words(frame(spark, rows), mix), taken_words(frame(spark, rows[::-1], 11), mix)
    assert key(a) == key(b)
    c, d = mix_sources(frame(spark, rows), mix)[0], mix_sources(frame(spark, rows[::-1], 3), mix)[0]
    assert key(c) == key(d)


def test_slots_and_blocks(spark):
    mix = Mix(block=16, shards=8)
    mixed, placed = mix_sources(frame(spark, docs()), mix)
    slots, drawn, shards = defaultdict(int), Counter(), defaultdict(set)
    for r in mixed.collect():
        slots[r.shard, r.slot] += r.n_words
        if (r.shard, r.slot) not in shards[r.number, r.block]:
            drawn[r.number, r.block] += 1
            shards[r.number, r.block].add((r.shard, r.slot))
    assert max(slots.values()) == 16
    per = defaultdict(list)
    total = {r.number: -(-r.source_size // 16) for r in placed.collect()}
    for (number, block), n in drawn.items():
        per[number].append(n)
    for number, counts in per.items():
        counts += [0] * (total[number] - len(counts))
        assert max(counts) - min(counts) <= 1      # no block again before all others
    numbers = defaultdict(set)
    for shard, slot in slots:
        numbers[shard].add(slot)
    assert all(x == set(range(len(x))) for x in numbers.values())


def test_mixed_texts(spark):
    rows, mix = docs(), Mix(block=16, shards=8)
    got = mixed_texts(frame(spark, rows), mix).collect()
    taken = defaultdict(int)
    for r in taken_words(frame(spark, rows), mix).collect():
        taken[r.doc_id] += r.taken
    left = Counter()
    for r in got:
        left[r.doc_id] += size(r.text)
    assert left == {i: n for i, n in taken.items() if n}      # both texts of id 7, the repeated rows as one
    assert len({(r.doc_id, r.text) for r in got}) == len(got) and all(r.n_chars == len(r.text) for r in got)
    by_id = defaultdict(set)
    for i, t, _ in rows:
        by_id[i] |= set(WORD.findall(t or ""))
    assert all(set(WORD.findall(r.text)) <= by_id[r.doc_id] for r in got)


def test_cut_keeps_the_text_of_adjacent_parts():
    assert _cut("a  b\tc d", [(2, 2), (0, 2)]) == "a  b\tc d"
    assert _cut("a  b\tc d", [(0, 2), (2, 2), (2, 2)]) == "a  b\tc d\nc d"


def test_query_on_documents(spark):
    from postresp.llm.queries import op5_mixing
    got = op5_mixing(spark, "/root/testdata/sf0.01").collect()
    taken, target, words = Counter(), {}, 0
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        words += r.size
        assert r.taken <= 2 * r.size
    assert sum(target.values()) == pytest.approx(1.5 * words)
    assert all(abs(taken[s] - t) <= 0.03 * t for s, t in target.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert taken_words(df).count() == 0 and mixed_texts(df).count() == 0
