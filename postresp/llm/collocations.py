"""Operator 11: phrase collocations, by best-first branch and bound over prefixes.

Phrases grow word by word.  A phrase of ``a`` occurrences whose first word has
``f`` scores at most ``a / f`` (its rest is found ``a`` times at least), and no
phrase is more frequent than its prefix, so ``a(prefix) / f(first word)`` bounds
every phrase that begins with a prefix.  Words and pairs are counted once.
Prefixes are expanded to three words in rounds, per language from the highest
bound down to a threshold; in the same pass the pairs that score at or above the
threshold are expanded to both sides, as a longer phrase may drop them.  A
language is settled when its surviving phrases at or above the threshold are as
many as wanted: whatever was not expanded is bounded below it, so ties are in.

A word is 64 bits of a hash of language and word; that no two words share one is
checked on the counted words, and the count repeated with another seed if two
do.  Counts are summed in each batch, then by Spark before each shuffle.  Which
pairs are to be expanded is broadcast as a table of at most ``MAX_SLOTS`` bytes
(a pair's slot by hash); pairs that share a slot are counted too and left out
afterwards, so the size of the table decides work, never results.

Defined results: a null or empty text has no words; a null language is ``und``;
repeated rows, also with one id, count as often as they stand there; texts are
taken whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postresp.llm.common import frugal, mix64, small_slices, stored, text_bytes
from postresp.llm.spans import LOWER, Hashes

SLICE = 4 << 20
#: bytes hashed at a time: prefix sums and powers take 40 bytes for each
HASHED = 1 << 19
MIN_COUNT = 10
TOP = 2000
#: a longer phrase with this share (percent) of a phrase's occurrences drops it
COVER_PERCENT = 50
SCALE = 1_000_000
#: the pairs first looked at, as a multiple of the phrases wanted; each further round takes four times as many
AHEAD = 2
MAX_SLOTS = 1 << 23
#: parts in which a language's phrases are ranked first
PARTS = 64
SEEDS = (0, 1, 2, 3)
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True

# what a round does with a pair
KNOWN, GROW, COVER = 1, 2, 4


class Words:
    """Words of a batch of texts: numbers ``ids`` into ``keys`` (hash of
    language and word), and ``joined``: the next word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        raw, offsets = text_bytes(texts)
        raw = LOWER[raw]
        self.raw = raw
        solid = ~_GAP[raw]
        edge = offsets[(offsets > 0) & (offsets < len(raw))]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        begins[edge] = solid[edge]
        stops[edge - 1] = solid[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        doc = np.searchsorted(offsets, self.starts, side="right") - 1
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[doc]
        tag = np.array([np.frombuffer(_digest(x, seed), np.uint64)[0] for x in self.langs], np.uint64)
        keys = mix64(self._hashes() ^ tag[self.lang]) if len(doc) else np.zeros(0, np.uint64)
        self.keys, self.first, self.ids, self.counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        breaks = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_BREAK[raw], dtype=np.int32, out=breaks[1:])
        self.joined = (doc[1:] == doc[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) if len(doc) else np.zeros(0, bool)

    def _hashes(self) -> np.ndarray:
        """Hashes of all words (the same wherever a word stands), some bytes at a time."""
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.raw) + HASHED, HASHED))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                base = self.starts[a]
                out[a:b] = Hashes.of_bytes(self.raw[base:self.ends[b - 1]])(self.starts[a:b] - base, self.ends[a:b] - base)
        return out

    def word(self, k: int) -> str:
        i = self.first[k]
        return self.raw[self.starts[i]:self.ends[i]].tobytes().decode()


def _digest(text: str, seed: int) -> bytes:
    return hashlib.blake2b(f"{seed}:{text}".encode(), digest_size=8).digest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _slots(a: np.ndarray, b: np.ndarray, slots: int) -> np.ndarray:
    """A pair's place in a table of ``slots`` (a power of two) bytes."""
    return (mix64(a + mix64(b)) & np.uint64(slots - 1)).astype(np.int64)


def _mapped(texts: DataFrame, emit, schema: str, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 0, SLICE):
            words = Words(batch.column(0), batch.column(1), seed)
            if len(words.ids):
                yield emit(words)

    return texts.mapInArrow(frugal(run), schema)


def _count_words(texts: DataFrame, seed: int) -> DataFrame:
    def emit(w: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [_signed(w.keys), pa.array([w.langs[k] for k in w.lang[w.first]], pa.string()),
             pa.array([w.word(k) for k in range(len(w.keys))], pa.string()), pa.array(w.counts.astype(np.int64))],
            names=["h", "lang", "word", "n"])

    found = _mapped(texts, emit, "h long, lang string, word string, n long", seed)
    entry = F.struct("lang", "word")
    return (found.groupBy("h").agg(F.min(entry).alias("low"), F.max(entry).alias("top"), F.sum("n").alias("n"))
            .select("h", "low.lang", "low.word", "n", (F.col("low") != F.col("top")).alias("shared")))


def _count_pairs(texts: DataFrame, seed: int, frequent: np.ndarray) -> DataFrame:
    """Pairs of neighbours of which both words may be frequent (``frequent``: bytes by slot of a word)."""
    table = texts.sparkSession.sparkContext.broadcast(frequent)

    def emit(w: Words) -> pa.RecordBatch:
        known = table.value[_slots(w.keys, np.zeros_like(w.keys), len(table.value))] > 0
        n = np.int64(len(w.keys))
        good = known[w.ids]
        at = np.flatnonzero(w.joined & good[:-1] & good[1:])
        pairs, counts = np.unique(w.ids[at] * n + w.ids[at + 1], return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(w.keys[pairs // n]), _signed(w.keys[pairs % n]), pa.array(counts.astype(np.int64))],
                                          names=["h1", "h2", "a"])

    return _mapped(texts, emit, "h1 long, h2 long, a long", seed).groupBy("h1", "h2").agg(F.sum("a").alias("a"))


def _count_triples(texts: DataFrame, seed: int, marks: np.ndarray) -> DataFrame:
    """Triples whose first pair is marked to grow, or one of whose pairs is marked as perhaps covered."""
    table = texts.sparkSession.sparkContext.broadcast(marks)

    def emit(w: Words) -> pa.RecordBatch:
        n = np.int64(len(w.keys))
        at = np.flatnonzero(w.joined)
        pair_at = np.full(len(w.ids), -1, np.int64)
        pairs, pair_at[at] = np.unique(w.ids[at] * n + w.ids[at + 1], return_inverse=True)
        flags = table.value[_slots(w.keys[pairs // n], w.keys[pairs % n], len(table.value))] if len(pairs) else np.zeros(0, np.uint8)
        begin = at[:-1][np.diff(at) == 1]
        left, right = flags[pair_at[begin]], flags[pair_at[begin + 1]]
        begin = begin[(left & KNOWN > 0) & (right & KNOWN > 0) & ((left & GROW > 0) | (right & COVER > 0))]
        triples, counts = np.unique(pair_at[begin] * n + w.ids[begin + 2], return_counts=True)
        first = pairs[triples // n] if len(triples) else triples
        return pa.RecordBatch.from_arrays(
            [_signed(w.keys[first // n]), _signed(w.keys[first % n]), _signed(w.keys[triples % n]), pa.array(counts.astype(np.int64))],
            names=["h1", "h2", "h3", "a"])

    found = _mapped(texts, emit, "h1 long, h2 long, h3 long, a long", seed)
    return found.groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a"))


def _table(rows: DataFrame, keys: list[str], marks: Column, slots: int) -> np.ndarray:
    """Bytes by slot: the marks of all rows in it.  At most ``slots`` rows reach the driver."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(k).to_numpy().view(np.uint64) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(_slots(*key, slots)), batch.column(2)], names=["slot", "marks"])

    pair = [F.col(k) for k in keys] + [F.lit(0).cast("long")] * (2 - len(keys))
    got = (rows.select(*pair, marks.cast("int").alias("marks")).toDF("x", "y", "marks").mapInArrow(place, "slot long, marks int")
           .groupBy("slot").agg(F.bit_or("marks").alias("marks")).toArrow())
    out = np.zeros(slots, np.uint8)
    out[got.column("slot").to_numpy()] = got.column("marks").to_numpy()
    return out


def _slots_for(n: int) -> int:
    return min(MAX_SLOTS, max(1 << 12, 1 << (8 * n).bit_length()))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimal numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    up = (F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a))).cast("decimal(38,0)")
    return F.call_function("div", up, (wide(left) * wide(right)).cast("decimal(38,0)"))


def counted_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, int]:
    """(texts, word counts, seed of the word hashes)."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    for seed in SEEDS:
        words = stored(_count_words(texts, seed), "collocation-words")
        if not words.where("shared").limit(1).count():
            return texts, words.drop("shared"), seed
    raise RuntimeError("two words share a 64-bit hash under every seed")


def _pairs(texts: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """Frequent pairs with score and bound; ``lang`` goes with the first word."""
    frequent = words.where(F.col("n") >= least)
    table = _table(frequent, ["h"], F.lit(KNOWN), _slots_for(frequent.count()))
    pairs = _count_pairs(texts, seed, table).where(F.col("a") >= least)
    one = frequent.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("n").alias("f1"))
    two = frequent.select(F.col("h").alias("h2"), F.col("word").alias("w2"), F.col("n").alias("f2"))
    pairs = pairs.join(one, "h1").join(two, "h2")
    return stored(pairs.withColumn("score", _score(F.col("a"), F.col("f1"), F.col("f2")))
                  .withColumn("bound", _score(F.col("a"), F.col("f1"), F.col("a"))), "collocation-pairs")


def _triples(counted: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Frequent triples with the lower of their two cuts' scores."""
    head = pairs.select("h1", "h2", "lang", "w1", "w2", F.col("f1").alias("l1"), F.col("a").alias("l2"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("f2").alias("r2"))
    t = counted.where(F.col("a") >= least).join(head, ["h1", "h2"]).join(tail, ["h2", "h3"])
    t = t.withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2")))
    second = F.col("s2") < F.col("s1")
    return t.select("h1", "h2", "h3", "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                    F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
                    F.least("s1", "s2").alias("score"))


def _best(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """``rank``, up to ``top`` per language; ranked in parts first, so that a
    language's rows do not meet in one task."""
    part = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def _survivors(pairs: DataFrame, triples: DataFrame, cuts: DataFrame) -> DataFrame:
    """Candidates at or above their language's threshold that no longer phrase drops."""
    held = triples.select("h1", "h2", "a").union(triples.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    two = (pairs.join(held, ["h1", "h2"], "left").where(F.coalesce(100 * F.col("longer") < COVER_PERCENT * F.col("a"), F.lit(True)))
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score"))
    every = two.unionByName(triples.select(*two.columns))
    return every.join(cuts.select("lang", "cut"), "lang").where(F.col("score") >= F.col("cut")).drop("cut")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two and three words."""
    texts, words, seed = counted_words(docs, text_col, lang_col)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = _pairs(texts, words, seed, least)
    slots = _slots_for(pairs.count())
    parts: list[DataFrame] = []
    found = None
    # one row per language: where its search stands.  No phrase scores above SCALE
    state = stored(pairs.select("lang").distinct().select("lang", F.lit(SCALE + 1).cast("long").alias("cut"), F.lit(False).alias("settled")), "collocation-state")
    wanted = AHEAD * top
    while state.where("NOT settled").limit(1).count():
        # the next threshold: the score of the wanted-th best pair, or all
        nth = _best(pairs.select("h1", "h2", "lang", "score"), wanted, F.desc("score")).where(F.col("rank") == wanted).select("lang", F.col("score").alias("next"))
        step = (state.join(nth, "lang", "left")
                .select("lang", "settled", F.col("cut").alias("before"), F.when(F.col("settled"), F.col("cut")).otherwise(F.coalesce("next", F.lit(0).cast("long"))).alias("cut")))
        step = stored(step, "collocation-state")
        open_pairs = pairs.join(step, "lang")
        fresh = lambda c: (~F.col("settled") & (F.col(c) >= F.col("cut")) & (F.col(c) < F.col("before"))).cast("int")
        marks = _table(open_pairs, ["h1", "h2"], F.lit(KNOWN) + GROW * fresh("bound") + COVER * fresh("score"), slots)
        if (marks & (GROW | COVER)).any():
            parts.append(stored(_triples(_count_triples(texts, seed, marks), pairs, least), "collocation-triples"))
        # the best pair of an open language is always marked, so there is a part from the first round on
        found = stored(_survivors(pairs, reduce(DataFrame.union, parts).dropDuplicates(["h1", "h2", "h3"]), step), "collocation-found")
        enough = found.groupBy("lang").count().where(F.col("count") >= top).select("lang", F.lit(True).alias("enough"))
        state = stored(step.join(enough, "lang", "left").select("lang", "cut", (F.col("settled") | (F.col("cut") == 0) | F.coalesce("enough", F.lit(False))).alias("settled")),
                       "collocation-state")
        wanted *= 4
    if found is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return (_best(found, top, F.desc("score"), F.desc("a"), F.col("phrase")).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
