"""Language identification with language-bitmask n-gram filters (operator 8).

Training counts letter 4-grams (word borders included) per language over all
labelled rows.  A gram belongs to a language if it makes up at least
``min_rate`` of the language's grams (so a language has 1 / min_rate grams at
most) and is not ``max_ratio`` times as common in another.  All languages share
one bit-sliced Bloom filter: a slot holds a bitmask of languages, a gram sets
its languages' bits in ``HASHES`` slots, and the AND of these slots returns all
languages that contain the gram.  A text's language is the one with the largest
share of the text's grams (popcount of its bit), corrected for the share that
the filter's false positives alone would give.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is everything when nothing was learned; a text without a gram gets the most
common language with its prior as score; ties go to the more common language;
null labels are not learned from; repeated rows count one by one; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postresp.llm.common import frugal, mix64, small_slices

GRAM = 4
HASHES = 3
UNKNOWN = "und"
SLICE = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each gram, its text's index, has the text a letter).

    Letters are lower-cased; a run of other characters is one blank; a gram's
    two inner characters are letters."""
    n = len(texts)
    joined = " " + " ".join(t or "" for t in texts) + " "
    # one code point for one, so that positions stay: the few longer forms keep their case
    lowered = joined.lower()
    if len(lowered) != len(joined):
        lowered = "".join(c if len(x := c.lower()) != 1 else x for c in joined)
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([1] + [len(t or "") + 1 for t in texts])
    is_letter = letters()[points]
    has = np.add.reduceat(is_letter, np.minimum(starts[:-1], len(points) - 1)) > 0 if n else np.zeros(0, bool)
    has &= np.array([bool(t) for t in texts], bool)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    where = np.flatnonzero(keep)
    chars = np.where(is_letter, points, 32)[where].astype(np.uint64)
    if len(chars) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    code = chars[:-3].copy()
    for k in range(1, GRAM):
        code = code * np.uint64(0x100000001B3) + chars[k:len(chars) - GRAM + 1 + k]
    inner = (chars[1:-2] != 32) & (chars[2:-1] != 32)
    at = where[1:-2][inner]
    return mix64(code[inner]), np.searchsorted(starts, at, side="right") - 1, has


@dataclass(frozen=True)
class Model:
    langs: list[str]           # by order of the bits
    prior: np.ndarray          # share of the training rows
    slots: np.ndarray          # (slots, ceil(languages / 8)) bitmasks
    false_positive: np.ndarray  # by language


def _slots(hashes: np.ndarray, m: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2 ** 64)) % np.uint64(m)).astype(np.int64)


def build(langs: list[str], prior: np.ndarray, hashes: np.ndarray, lang: np.ndarray, m: int) -> Model:
    slots = np.zeros((m, max(1, -(-len(langs) // 8))), np.uint8)
    bit = np.left_shift(1, lang % 8).astype(np.uint8)
    for at in _slots(hashes, m):
        np.bitwise_or.at(slots, (at, lang // 8), bit)
    fill = np.unpackbits(slots, axis=1, bitorder="little")[:, :len(langs)].mean(axis=0)
    return Model(langs, prior, slots, fill ** HASHES)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    n, size = len(texts), len(model.langs)
    hashes, doc, has = grams(texts)
    if not size:
        return [UNKNOWN] * n, np.zeros(n)
    mask = np.full((len(hashes), model.slots.shape[1]), 255, np.uint8)
    for at in _slots(hashes, len(model.slots)):
        mask &= model.slots[at]
    hits = np.concatenate([np.bincount(doc * 256 + mask[:, b], minlength=256 * n).reshape(n, 256) @ _BITS
                           for b in range(mask.shape[1])], axis=1)[:, :size]
    total = np.bincount(doc, minlength=n)
    share = np.clip((hits / np.maximum(total, 1)[:, None] - model.false_positive) / (1 - np.minimum(model.false_positive, 0.999)), 0, 1)
    order = np.argsort(-model.prior, kind="stable")
    best = order[np.argmax(share[:, order], axis=1)]
    top, whole = share[np.arange(n), best], share.sum(axis=1)
    score = np.where(whole > 0, top / np.where(whole > 0, whole, 1), model.prior[order[0]])
    return [model.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", min_rate: float = 2e-5, max_ratio: float = 20.0,
        slots: int = 1 << 20) -> Model:
    """Learn from all rows of ``labelled`` with a text and a label.

    To the driver come one row per language and at most 1 / ``min_rate`` grams
    of each; the filter has ``slots`` slots whatever the input."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        docs: dict[str, int] = {}
        for batch in small_slices(batches, 0, SLICE):
            hashes, doc, _ = grams(batch.column(0).to_pylist())
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                docs[lang] = docs.get(lang, 0) + int(own.sum())
                parts = held.setdefault(lang, [])
                parts.append(np.unique(hashes[own[doc]], return_counts=True))
                if len(parts) >= 16:
                    held[lang] = [_sum(parts)]
        for lang, parts in held.items():
            keys, counts = _sum(parts)
            for start in range(0, len(keys), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(counts[part].astype(np.int64))],
                    names=["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.int64()), pa.array([docs[lang]], pa.int64())],
                                             names=["lang", "gram", "n"])

    counted = rows.mapInArrow(frugal(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    # a null gram carries the number of documents
    totals = counted.groupBy("lang").agg(F.sum(F.when(F.col("gram").isNull(), F.col("n"))).alias("docs"),
                                         F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))).alias("grams"))
    found = sorted((r.lang, r.docs, r.grams or 0) for r in totals.collect())
    langs = [r[0] for r in found]
    numbers = labelled.sparkSession.createDataFrame([(r[0], i, max(r[2], 1)) for i, r in enumerate(found)], "lang string, number int, grams long")
    rated = (counted.where("gram is not null").join(F.broadcast(numbers), "lang")      # one row per language
             .select("gram", "number", "n", (F.col("n") / F.col("grams")).alias("rate")).where(F.col("rate") >= min_rate))
    most = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("most", most).where(F.col("rate") * max_ratio >= F.col("most")).select("gram", "number").toArrow()
    counted.unpersist()
    docs = np.array([r[1] for r in found], float)
    return build(langs, docs / max(docs.sum(), 1), kept["gram"].to_numpy().view(np.uint64), kept["number"].to_numpy().astype(np.int64), slots)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # a fixed number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 1, SLICE):
            langs, scores = predict(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(frugal(run), "doc_id long, lang_pred string, score double"))
