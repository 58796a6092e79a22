"""Mixing sources to target weights (operator 5).

Each source's documents, in id order, are one stream of words cut into blocks
of ``BLOCK`` words.  A source's quota of blocks follows from its target; the
quotas are dealt to output shards by multinomial draws whose weights are the
quotas still open, so that they come out exactly.  The j-th slot of a source
takes block ``permutation(j mod n)`` of pass ``j div n``: every pass over a
source is a pseudorandom permutation of its block numbers, keyed by seed,
source and pass, so that no block is drawn again before all others were.  Slots
and blocks are joined by (source, block number).

The number of sources is not bounded (hosts, authors), so they stay in a table:
targets are found by a rate per weight that a few aggregates settle, and draws
go down a tree of ``FAN`` sources a node, each node dealing the slots that its
parent drew for it.  The driver sees sums only.

Defined results: a null source is a source of its own, last in order; null and
empty texts have size 0 and are never taken; documents of equal id are ordered
by their text's hash, and repeated rows are streamed one by one (``mixed_texts``
returns them as one row); a null id sorts first; a source without words has
target 0; other columns are ignored or kept; an empty table gives an empty
result.  The same input gives the same mix under any partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postresp.llm.common import frugal, mix64, small_slices, stored, WORD_PATTERN
from postresp.operators.frame import row_number_exact

BLOCK = 128
SHARDS = 256
CHUNKS = 1024        #: pieces in which a source's running word count is worked out
FAN = 1024           #: sources (or nodes of sources) dealt to in one task
SLOT_CHUNK = 50_000  #: slots that one input row of the permutation step stands for


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)   #: by order of the sources, repeating
    share: float = 1.5                       #: words of the mix over words of the input
    most: int = 2                            #: times a source's size that its target may reach
    block: int = BLOCK
    shards: int = SHARDS
    seed: int = 20


def with_targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``sources`` (``number, source_size``) with ``target``, the words each gives:
    the total shared by weight, stopped at ``most`` times the source's size, the
    excess shared again until none is above.

    The targets are ``least(cap, weight * rate)``.  The rate rises from the total
    over all weights: each aggregate sums, per weight, the sources below their cap
    and the caps of the others, until no more sources are full."""
    k = len(mix.weights)
    place = F.pmod("number", F.lit(k)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), place + 1)
    cap = F.col("source_size") * mix.most
    words, caps = sources.agg(F.sum("source_size"), F.sum(cap)).first()
    total, rate, full = min(mix.share * (words or 0), caps or 0), 0.0, -1
    while True:
        stopped = weight * F.lit(rate) >= cap
        sums = sources.where("source_size > 0").groupBy(place.alias("place")).agg(
            F.count_if(~stopped).alias("open"), F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)).alias("caps"),
            F.count_if(stopped).alias("full")).collect()          # a row per weight
        now, share = sum(r.full for r in sums), sum(mix.weights[r.place] * r.open for r in sums)
        if now == full or not share:
            break
        full, rate = now, (total - sum(r.caps for r in sums)) / share
    return sources.withColumn("target", F.least(cap.cast("double"), weight * F.lit(rate)))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 at ``index``: four Feistel rounds
    over the next even power of two, walked on until the value is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key & (1 << 64) - 1))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def dealt(quotas: np.ndarray, wanted: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) counts: shard by shard a multinomial draw of ``wanted``
    with the open quotas as weights; columns sum to the quotas."""
    left = np.array(quotas, np.int64)
    out = np.zeros((len(wanted), len(left)), np.int64)
    for h, want in enumerate(wanted):
        want = int(want)
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[h] += drawn
            left -= drawn
            want -= int(drawn.sum())
    return out


def even(total: int, shards: int) -> list[int]:
    """``total`` slots as shards of sizes that differ by one at most."""
    return [total // shards + (h >= shards - total % shards) for h in range(shards)]


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, content, size, chunk``: the only pass over the texts."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("content"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    return stored(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "content"), F.lit(CHUNKS)).cast("int")), "mix-sizes")


def _streams(rows: DataFrame) -> DataFrame:
    """``doc_id, source, content, size, start``: each document's place in its
    source's stream of words; a running sum per piece plus the pieces' offsets,
    so no source is one group.  Repeated rows are one row of the running sum."""
    rows = rows.groupBy("source", "chunk", "doc_id", "content", "size").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("source", "chunk").orderBy("doc_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("source", "chunk").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    return (rows.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
            .join(pieces, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .select("doc_id", "source", "content", "size", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("start")))


def shard_plan(quotas: DataFrame, n_sources: int, mix: Mix) -> DataFrame:
    """``number, blocks, shard, first, place, slots`` from ``number, quota, blocks``:
    how many slots of each shard a source fills, after how many of its own in
    earlier shards (``first``) and of other sources in the shard (``place``)."""
    shards, seed, fan = mix.shards, mix.seed, FAN

    def deal(node: int, level: int, children: pd.DataFrame, parent: pd.DataFrame) -> tuple:
        children = children.sort_values("node")
        quota = children["quota"].to_numpy(np.int64)
        wanted = parent["counts"].iloc[0] if len(parent) else even(int(quota.sum()), shards)
        places = np.asarray(parent["places"].iloc[0] if len(parent) else np.zeros(shards), np.int64)
        counts = dealt(quota, wanted, np.random.default_rng([seed, level, node]))
        return children, counts, np.cumsum(counts, axis=1) - counts + places[:, None]

    def inner(level: int):
        def run(key: tuple, children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
            children, counts, places = deal(int(key[0]), level, children, parent)
            return pd.DataFrame({"node": children["node"].to_numpy(), "counts": list(counts.T), "places": list(places.T)})
        return run

    def leaves(key: tuple, children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        children, counts, places = deal(int(key[0]), 0, children, parent)
        at, shard = np.nonzero(counts.T)
        firsts = np.cumsum(counts, axis=0) - counts
        return pd.DataFrame({"number": children["node"].to_numpy()[at], "blocks": children["blocks"].to_numpy()[at], "shard": shard,
                             "first": firsts[shard, at], "place": places[shard, at], "slots": counts[shard, at]})

    tree = [quotas.where("quota > 0").select(F.col("number").alias("node"), "quota", "blocks")]
    while fan ** len(tree) < n_sources:
        tree.append(tree[-1].groupBy(F.expr(f"node div {fan}").alias("node")).agg(F.sum("quota").alias("quota")))
    parents = quotas.sparkSession.createDataFrame([], "node long, counts array<long>, places array<long>")   # the root has none
    for level in range(len(tree) - 1, -1, -1):
        pairs = tree[level].groupBy(F.expr(f"node div {fan}").alias("parent")).cogroup(parents.groupBy("node"))
        if level:
            parents = pairs.applyInPandas(inner(level), "node long, counts array<long>, places array<long>")
    return pairs.applyInPandas(leaves, "number long, blocks long, shard int, first long, place long, slots long")


def _draws(sources: DataFrame, n_sources: int, mix: Mix) -> DataFrame:
    """``number, block, shard, slot``: one row per slot of the mix; ``number``
    is the source's place in order."""
    blocks = F.ceil(F.col("source_size") / mix.block)
    quotas = sources.where("source_size > 0").select("number", F.rint(F.col("target") * blocks / F.col("source_size")).cast("long").alias("quota"),
                                                     blocks.alias("blocks"))
    rows = shard_plan(quotas, n_sources, mix)      # at most shards x sources rows, no more than slots
    rows = rows.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_CHUNK).cast("long"))))
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "number", "shard", "skip")
    seed = mix.seed

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, shard, first, place, slots, skip in zip(*(c.to_pylist() for c in batch.columns)):
                offset = np.arange(skip, min(skip + SLOT_CHUNK, slots))
                slot = first + offset
                block = np.empty(len(slot), np.int64)
                for turn in range(int(slot[0] // n), int(slot[-1] // n) + 1):
                    own = slot // n == turn
                    key = int(mix64(np.array([seed * 0x9E3779B1 + number * 0x10001 + turn * 0x100000001], np.uint64))[0])
                    block[own] = permuted(slot[own] % n, n, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), number, np.int64)), pa.array(block), pa.array(np.full(len(slot), shard, np.int32)),
                     pa.array(place + offset)], names=["number", "block", "shard", "slot"])

    return rows.mapInArrow(frugal(draw), "number long, block long, shard int, slot long")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix and the documents it is made of.

    First: one row per slot and document part, ``shard, slot, number, block,
    start, doc_id, content, from_word, n_words`` (words ``from_word`` and on of
    the document that ``(number, start)`` names).  Second: ``doc_id, content,
    source, size, start, number, source_size, target``, a row per row of ``docs``.
    """
    rows = _sizes(docs, id_col, text_col, source_col)
    streams = _streams(rows)
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # strings compare by code point; null is last
    numbered = stored(row_number_exact(per_source, [F.col("source").isNull(), F.col("source")], "number"), "mix-sources")
    sources = with_targets(numbered, mix)
    table = sources.withColumnRenamed("source", "s")
    placed = (streams.join(table, F.col("source").eqNullSafe(F.col("s")))
              .select("doc_id", "content", "source", "size", "start", "number", "source_size", "target"))
    first, last = F.expr(f"start div {mix.block}"), F.expr(f"(start + size - 1) div {mix.block}")
    parts = placed.where("size > 0").select("number", "start", "size", "doc_id", "content", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * mix.block, F.col("start"))
    end = F.least((F.col("block") + 1) * mix.block, F.col("start") + F.col("size"))
    parts = parts.select("number", "block", "start", "doc_id", "content", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"))
    # both sides grow with the input, and the draws' size is not known before they are made: never broadcast
    mixed = _draws(sources, numbered.count(), mix).hint("merge").join(parts, ["number", "block"])
    return mixed.select("shard", "slot", "number", "block", "start", "doc_id", "content", "from_word", "n_words"), placed


def taken_words(docs: DataFrame, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of each row of ``docs``."""
    mixed, placed = mix_sources(docs, mix, **columns)
    taken = mixed.groupBy("number", "start").agg(F.sum("n_words").alias("taken"))
    full = placed.where("size > 0").join(taken, ["number", "start"], "left")
    out = full.unionByName(placed.where("size = 0").withColumn("taken", F.lit(None).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORD = re.compile(WORD_PATTERN)


def _cut(text: str, parts: list[tuple[int, int]]) -> str:
    """The words of ``parts`` (first word, number of words), each drawn part
    once per draw: passes over the document, adjacent parts of a pass as one."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out = []
    left = sorted(parts)
    while left:
        rest, run = [], None
        for first, n in left:
            if run and first < run[1]:
                rest.append((first, n))
            elif run and first == run[1]:
                run = (run[0], first + n)
            else:
                if run:
                    out.append(run)
                run = (first, first + n)
        out.append(run)
        left = rest
    return "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in out)


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """``docs`` after mixing, all columns: a document's text is what the mix
    takes of it, pass after pass; one the mix takes nothing of is left out.
    An integer column ``n_chars`` follows the text."""
    mixed, _ = mix_sources(docs, mix, id_col, text_col, source_col)
    parts = mixed.groupBy(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id"), "content", "number").agg(
        F.collect_list(F.struct("from_word", "n_words")).alias("parts"))
    parts = parts.groupBy("d", "no_id", "content").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    doc_id = F.col(id_col).cast("long")
    keyed = docs.select(F.coalesce(doc_id, F.lit(0)).alias("d"), doc_id.isNull().alias("no_id"),
                        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("content"),
                        F.struct("*").alias("row"))
    joined = keyed.dropDuplicates(["d", "no_id", "content"]).join(parts, ["d", "no_id", "content"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 0, 4 << 20):
            texts = [_cut(t, [(p["from_word"], p["n_words"]) for p in ps])
                     for t, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            row = batch.column(2)
            fields = [row.type.field(i) for i in range(row.type.num_fields)]
            new = {text_col: texts, "n_chars": [len(t) for t in texts]}
            columns = [pa.array(new[f.name], f.type) if f.name in new and (f.name == text_col or pa.types.is_integer(f.type))
                       else row.field(i) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields)], names=["row"])

    # the text is read from the row after the join, so that it is shuffled once
    return joined.select(F.col("row")[text_col].cast("string").alias("text"), "parts", "row").mapInArrow(frugal(cut), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
