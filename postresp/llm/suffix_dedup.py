"""Suffix-array substring dedup (operator 1).

Texts are bytes; every byte covered by a ``WINDOW``-byte string that also
starts earlier (smaller id, or same document and earlier start) is removed.

Sorting all suffixes of a corpus would move it many times over.  Here each
window is owned by its anchor, the K-byte gram of the lowest hash in it (the
leftmost on ties), so equal windows have equal anchors at equal places, and
only suffixes at anchors that occur twice are sorted.  The windows of one
anchor occurrence form a block (about 135 bytes of text):

1. per text, anchors and blocks; of equal blocks in a task all but the first
   are removed at once, so copies are combined before the shuffle;
2. by anchor gram, of equal blocks all but the first are removed; anchors that
   stand in different blocks are left over;
3. for these, the blocks' texts meet by anchor gram: their suffixes at the
   anchor form an enhanced suffix array, its common-prefix intervals are found
   with a stack, and left-context diversity gives the maximal repeats with all
   occurrences (``repeats.py``); all but the first occurrence are removed;
4. removed stretches are joined to the texts and cut out.

A gram with more than ``GROUP`` different blocks is not brought together: its
windows are hashed one by one and their first places found by an aggregation.

Defined results: null and empty texts have nothing removed; a null id sorts
last; documents of one id are ordered by their text's hash; of repeated rows
all but one are removed whole if they have ``WINDOW`` bytes; texts shorter than
that stay; other columns are kept by ``cut_texts``, which also drops characters
that a cut leaves incomplete; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postresp.llm.common import frugal, mix64, small_slices, stored
from postresp.llm.repeats import anchored_repeats
from postresp.llm.spans import Hashes

WINDOW = 100
GRAM = 32
GROUP = 20_000
SLICE = 1 << 20
PIECE = 4 << 20          #: longer texts are read in overlapping pieces
LOCAL = 1 << 18          #: blocks that a task combines at a time
_LAST = (1 << 63) - 1    #: stands for a null id
_POSITION = np.uint64((1 << 24) - 1)


def blocks(texts: list[bytes], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Blocks of texts (together below 16 MB): ``text`` (index), ``start``,
    ``end``, ``anchor`` (offset of the anchor in the block), ``gram``, ``block``
    (hashes).  The windows that start in a block's first ``end - start - window
    + 1`` bytes are owned by its anchor; every window has one owner."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n, grams = len(raw), window - GRAM + 1      # grams in a window
    if n < window:
        return {k: np.zeros(0, np.uint64 if k in ("gram", "block") else np.int64) for k in ("text", "start", "end", "anchor", "gram", "block")}
    sums = Hashes.of_bytes(raw)
    at = np.arange(n - GRAM + 1)
    gram = mix64(sums.plain(at, at + GRAM))
    low = (gram & ~_POSITION) | at.astype(np.uint64)
    size = 1
    while 2 * size <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if grams > size:
        low = np.minimum(low[:size - grams], low[grams - size:])
    owner = (low & _POSITION).astype(np.int64)
    ends = np.repeat(offsets[1:], sizes)[:len(owner)]
    inside = np.flatnonzero(np.arange(len(owner)) + window <= ends)
    if not len(inside):
        return blocks([], window)
    own = owner[inside]
    first = np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)])
    begin = inside[first]
    stop = inside[np.concatenate([first[1:], [True]])] + window
    anchor = own[first]
    text = np.searchsorted(offsets, begin, side="right") - 1
    place = anchor - begin
    return {"text": text, "start": begin - offsets[text], "end": stop - offsets[text], "anchor": place, "gram": gram[anchor],
            "block": mix64(sums(begin, stop) + mix64(place.astype(np.uint64) + np.uint64(1)))}


def _pieces(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(offset, piece): every window of the text is in one piece."""
    if len(text) <= PIECE:
        yield 0, text
        return
    for offset in range(0, len(text) - window + 1, PIECE - window + 1):
        yield offset, text[offset:offset + PIECE]


_NAMES = ["gram", "block", "doc", "tie", "start", "size"]
_ROW = "gram long, block long, doc long, tie long, start long, size int"


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def _merged(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching stretches of a document as one."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    if not len(doc):
        return doc, tie, start, end
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])
    group = np.cumsum(other) - 1
    # running maximum of the ends within each document
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    last = np.concatenate([fresh[1:], [True]])
    return doc[fresh], tie[fresh], start[fresh], reach[last]


def _later(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order by gram, block, place; whether each has an equal block before it)."""
    order = np.lexsort((rows["start"], rows["tie"], rows["doc"], rows["block"], rows["gram"]))
    gram, block = rows["gram"][order], rows["block"][order]
    later = np.zeros(len(order), bool)
    later[1:] = (gram[1:] == gram[:-1]) & (block[1:] == block[:-1])
    return order, later


#: a stretch travels as a row whose ``size`` is -1 and whose ``block`` is its end
def _find(window: int):
    """Step 1: blocks of all texts, those with an equal one before in the same
    task as removed stretches."""

    def settled(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {k: np.concatenate([h.pop(k) for h in held]) for k in list(held[0])}
        order, later = _later(rows)
        rows = {k: v[order] for k, v in rows.items()}
        new = {k: v[~later] for k, v in rows.items()}
        yield _batch(_NAMES, [new["gram"], new["block"], new["doc"], new["tie"], new["start"],
                              ((new["end"] - new["start"] - window) << 8 | new["anchor"]).astype(np.int32)])
        gone = [rows[k][later] for k in ("doc", "tie", "start")] + [rows["end"][later]]
        doc, tie, start, end = _merged(*gone)
        yield _batch(_NAMES, [mix64(doc.view(np.uint64)), end, doc, tie, start, np.full(len(doc), -1, np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def add(texts: list[bytes], where: list[tuple[int, int, int]]) -> None:
            nonlocal count
            found = blocks(texts, window)
            places = np.array(where, np.int64).reshape(-1, 3)[found.pop("text")]
            found["doc"], found["tie"] = places[:, 0], places[:, 1]
            found["start"], found["end"] = found["start"] + places[:, 2], found["end"] + places[:, 2]
            held.append(found)
            count += len(found["doc"])

        for batch in small_slices(batches, 2, SLICE):
            texts, where = [], []
            for doc, tie, text in zip(*(c.to_pylist() for c in batch.columns)):
                for offset, piece in _pieces((text or "").encode(), window):
                    if len(piece) == PIECE:
                        add([piece], [(doc, tie, offset)])
                    else:
                        texts.append(piece)
                        where.append((doc, tie, offset))
            add(texts, where)
            if count >= LOCAL:
                yield from settled(held)
                held, count = [], 0
        if held:
            yield from settled(held)

    return run


def _first(window: int):
    """Step 2, for whole grams: removed stretches (``gram`` null) and the blocks
    whose gram stands in different blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        rows = dict(zip(_NAMES, (np.concatenate(c) for c in zip(*held))))
        done = rows["size"] < 0
        stretches = [[rows[k][done] for k in ("doc", "tie", "start", "block")]]
        rows = {k: v[~done] for k, v in rows.items()}
        order, later = _later(rows)
        rows = {k: v[order] for k, v in rows.items()}
        end = rows["start"] + (rows["size"] >> 8) + window
        stretches.append([rows["doc"][later], rows["tie"][later], rows["start"][later], end[later]])
        doc, tie, start, end = _merged(*(np.concatenate(c) for c in zip(*stretches)))
        empty = pa.nulls(len(doc), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, pa.array(doc), pa.array(tie), pa.array(start), pa.array(end), pa.nulls(len(doc), pa.int32())],
                                         names=["gram", "doc", "tie", "start", "end", "size"])
        rows = {k: v[~later] for k, v in rows.items()}
        gram = rows["gram"]
        same = gram[1:] == gram[:-1]
        shared = np.zeros(len(gram), bool)
        shared[1:] |= same
        shared[:-1] |= same
        rows = {k: v[shared] for k, v in rows.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["gram"]), pa.array(rows["doc"]), pa.array(rows["tie"]), pa.array(rows["start"]),
             pa.nulls(len(rows["gram"]), pa.int64()), pa.array(rows["size"])], names=["gram", "doc", "tie", "start", "end", "size"])

    return run


def _block_texts(window: int):
    """Step 3a: the texts of the blocks that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "doc", "tie", "start", "anchor", "text"]
        for batch in small_slices(batches, 2, SLICE):
            out = [[] for _ in names]
            for doc, tie, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for p in places:
                    start = p["start"]
                    for column, value in zip(out, (p["gram"], doc, tie, start, p["size"] & 255, raw[start:start + (p["size"] >> 8) + window])):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


def _repeats(window: int):
    """Step 3b: of each maximal repeat, all occurrences but the first, as one
    stretch per block (all of a block's repeats contain its anchor)."""

    def stretches(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        lefts = [r[5][:r[4]][::-1] for r in rows]
        rights = [r[5][r[4]:] for r in rows]
        places = [r[1:4] for r in rows]
        reach: dict[int, tuple[int, int]] = {}
        for left, right, members in anchored_repeats(lefts, rights, window):
            first = min(members, key=places.__getitem__)
            for i in members:
                if i != first:
                    old = reach.get(i, (0, 0))
                    reach[i] = max(old[0], left), max(old[1], right)
        for i, (left, right) in reach.items():
            _, doc, tie, start, anchor, _ = rows[i]
            yield doc, tie, start + anchor - left, start + anchor + right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rows, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "tie", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != gram:
                    if len(rows) > 1:
                        out += stretches(rows)
                    gram, rows = row[0], []
                rows.append(row)
            if len(out) > 10_000:
                yield made()
                out = []
        if len(rows) > 1:
            out += stretches(rows)
        if out:
            yield made()

    return run


def _windows(window: int):
    """For very common grams: a hash of each window of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 2, SLICE):
            for doc, tie, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(text.encode(), np.uint8)
                sums = Hashes.of_bytes(raw)
                for p in places:
                    at = p["start"] + np.arange((p["size"] >> 8) + 1)
                    n = len(at)
                    yield _batch(["gram", "hash", "doc", "tie", "start"],
                                 [np.full(n, p["gram"], np.int64), sums(at, at + window), np.full(n, doc, np.int64), np.full(n, tie, np.int64), at])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc, tie, copy, text, row``: (doc, tie) names a text, copy its repeats."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    clash = bool(docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").limit(1).count())
    keyed = docs.select(doc.alias("doc"), (F.xxhash64(text) if clash else F.lit(0).cast("long")).alias("tie"), text.alias("text"), F.struct("*").alias("row"))
    if not clash:
        return keyed.withColumn("copy", F.lit(1)), False
    return keyed.withColumn("copy", F.row_number().over(Window.partitionBy("doc", "tie").orderBy(F.lit(0)))), True


def _places(rows: DataFrame, column: Column, name: str) -> DataFrame:
    return rows.groupBy("doc", "tie").agg(F.collect_list(column).alias(name))


def removed_stretches(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, tie, start, end``: stretches of bytes to remove (they may overlap)."""
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.where("copy = 1").select("doc", "tie", "text")
    found = texts.mapInArrow(frugal(_find(window)), _ROW).repartition(n, "gram")
    known = stored(found.mapInArrow(frugal(_first(window)), "gram long, doc long, tie long, start long, end long, size int"), "blocks")
    done = known.where("gram IS NULL").select("doc", "tie", "start", "end")
    left = known.where("gram IS NOT NULL")
    many = left.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("gram")
    place = F.struct("gram", "start", "size")
    hot = many.limit(1).count() > 0
    if hot:
        common = left.join(many, "gram", "left_semi")
        left = left.join(many, "gram", "left_anti")
        every = (texts.join(_places(common, place, "places"), ["doc", "tie"]).select("doc", "tie", "text", "places")
                 .mapInArrow(frugal(_windows(window)), "gram long, hash long, doc long, tie long, start long"))
        firsts = every.groupBy("gram", "hash").agg(F.min(F.struct("doc", "tie", "start")).alias("first"))
        later = every.join(firsts, ["gram", "hash"]).where(F.struct("doc", "tie", "start") > F.col("first"))
        done = done.union(later.select("doc", "tie", "start", (F.col("start") + window).alias("end")))
    suffixes = (texts.join(_places(left, place, "places"), ["doc", "tie"]).select("doc", "tie", "text", "places")
                .mapInArrow(frugal(_block_texts(window)), "gram long, doc long, tie long, start long, anchor int, text binary"))
    repeats = (suffixes.repartition(n, "gram").sortWithinPartitions("gram")
               .mapInArrow(frugal(_repeats(window)), "doc long, tie long, start long, end long"))
    return done.union(repeats)


def _joined(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    keyed, _ = _keyed(docs, id_col, text_col)
    spans = _places(removed_stretches(keyed, window), F.struct("start", "end"), "spans")
    return keyed.join(spans, ["doc", "tie"], "left").select("doc", "copy", "text", "spans", "row")


def _kept(text: bytes, copy: int, spans: list[dict] | None, window: int) -> tuple[bytes, int]:
    """(the remaining bytes, number of maximal removed runs)."""
    if copy > 1 and len(text) >= window:
        return b"", 1
    out, at, runs = [], 0, 0
    end = -1
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if s > end:
            runs += 1
            out.append(text[at:s])
        end = at = max(e, end)
    out.append(text[at:])
    return b"".join(out), runs


def dedup_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 2, SLICE):
            out = []
            for doc, copy, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                kept, runs = _kept(raw, copy, spans, window)
                out.append((None if doc == _LAST else doc, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(docs, id_col, text_col, window).select("doc", "copy", "text", "spans")
    return rows.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the removed bytes cut out of the
    text (an integer column ``n_chars`` follows it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 1, SLICE):
            row = batch.column(3)
            fields = [row.type.field(i) for i in range(row.type.num_fields)]
            names = [f.name for f in fields]
            texts = []
            for copy, text, spans, old in zip(*(batch.column(i).to_pylist() for i in range(3)), row.field(names.index(text_col)).to_pylist()):
                texts.append(old if old is None else _kept(text.encode(), copy, spans, window)[0].decode("utf-8", "ignore"))
            new = {text_col: texts, "n_chars": [None if t is None else len(t) for t in texts]}
            columns = [pa.array(new[f.name], f.type) if f.name in new and (f.name == text_col or pa.types.is_integer(f.type))
                       else row.field(i) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields)], names=["row"])

    # the text is read from the row after the join, so that it is shuffled once
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text")
    rows = _joined(docs, id_col, text_col, window).select("copy", text, "spans", "row")
    return rows.mapInArrow(frugal(run), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
