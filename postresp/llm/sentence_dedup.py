"""Sliding sentence spans (operator 3).

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, at a line
feed, or with the text.  From every sentence, forwards and backwards, the
shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words that begins
or ends with it is taken; a longer run that is repeated consists of such runs,
all of them repeated.  (Without a number of words, two interjections in a row
would make clean documents lose text: figures in the README.)  Runs are compared by two hashes of their words, A-Z lower-cased, over
the whole table; every run but the first of its kind (smaller id, then earlier)
is repeated, and sentences covered by a repeated run that is not the first are
removed with the white space after them.

Equal runs in a task are combined before the shuffle, so a passage that very
many documents share arrives once per task, not once per document.

Defined results: null and empty texts have no sentences; a text with fewer
sentences than a run keeps everything; a null id sorts last; documents
of one id are ordered by their text's hash; of repeated rows all but one lose
every sentence that is in a run; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postresp.llm.common import frugal, mix64, small_slices, text_bytes
from postresp.llm.spans import LOWER, Hashes, owners, word_spans
from postresp.llm.suffix_dedup import _LAST, _batch, _keyed, _later, _merged

SENTENCES = 2
WORDS = 10               #: words of a run at least
SLICE = 1 << 20
LOCAL = 1 << 18          #: runs that a task combines at a time
_NAMES = ["gram", "block", "doc", "tie", "start", "size"]
_ROW = "gram long, block long, doc long, tie long, start long, size long"

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class Sentences:
    """Sentences and runs of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = text_bytes(texts)
        starts, ends = word_spans(self.raw, self.offsets)
        doc = owners(starts, self.offsets)
        n = len(starts)
        last = np.ones(n, bool)
        if n:
            feeds = np.concatenate([[0], np.cumsum(self.raw == 10)])
            last[:-1] = _ENDS[self.raw[ends[:-1] - 1]] | (feeds[starts[1:]] > feeds[ends[:-1]]) | (doc[1:] != doc[:-1])
        self.to = np.flatnonzero(last) + 1                         # words of each sentence: [of, to)
        self.of = np.concatenate([[0], self.to[:-1]]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.of] if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))   # sentences of each text
        self.begin = starts[self.of] if n else np.zeros(0, np.int64)
        self.words = (starts, ends)

    def runs(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) sentence of every run, each pair once."""
        n = len(self.of)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n)
        ahead = np.maximum(at + SENTENCES - 1, np.searchsorted(self.to, self.of + words))
        back = np.minimum(at - SENTENCES + 1, np.searchsorted(self.of, self.to - words, side="right") - 1)
        a = np.concatenate([at, back])
        b = np.concatenate([ahead, at])
        good = (a >= 0) & (b < n)
        a, b = a[good], b[good]
        good = self.doc[a] == self.doc[b]
        pairs = np.unique(a[good] * n + b[good])
        return pairs // n, pairs % n

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower = Hashes.of_bytes(LOWER[self.raw])(*self.words)
        return tuple(Hashes(mix64(lower + np.uint64(k)))(self.of[a], self.to[b]) for k in (1, 2))


def _found(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Runs of all texts: the first of each kind in the task, and stretches of
    sentences (``size`` -1, ``block`` the end) covered by the others."""
    held: list[dict[str, np.ndarray]] = []

    def settled() -> Iterator[pa.RecordBatch]:
        rows = {k: np.concatenate([h.pop(k) for h in held]) for k in list(held[0])}
        held.clear()
        order, later = _later(rows)
        rows = {k: v[order] for k, v in rows.items()}
        new = {k: v[~later] for k, v in rows.items()}
        yield _batch(_NAMES, [new["gram"], new["block"], new["doc"], new["tie"], new["start"], new["end"] - new["start"]])
        doc, tie, start, end = _merged(*(rows[k][later] for k in ("doc", "tie", "start", "end")))
        yield _batch(_NAMES, [mix64(doc.view(np.uint64)), end, doc, tie, start, np.full(len(doc), -1, np.int64)])

    for batch in small_slices(batches, 2, SLICE):
        s = Sentences(batch.column(2))
        a, b = s.runs(words)
        one, two = s.hashes(a, b)
        doc = s.doc[a]
        base = s.first[doc]
        held.append({"gram": one, "block": two, "doc": batch.column(0).to_numpy()[doc], "tie": batch.column(1).to_numpy()[doc],
                     "start": a - base, "end": b + 1 - base})
        if sum(len(h["doc"]) for h in held) >= LOCAL:
            yield from settled()
    if held:
        yield from settled()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole kinds of runs, the stretches of all but the first."""
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    rows = dict(zip(_NAMES, (np.concatenate(c) for c in zip(*held))))
    done = rows["size"] < 0
    stretches = [[rows[k][done] for k in ("doc", "tie", "start", "block")]]
    rows = {k: v[~done] for k, v in rows.items()}
    order, later = _later(rows)
    rows = {k: v[order][later] for k, v in rows.items()}
    stretches.append([rows["doc"], rows["tie"], rows["start"], rows["start"] + rows["size"]])
    yield _batch(["doc", "tie", "start", "end"], list(_merged(*(np.concatenate(c) for c in zip(*stretches)))))


def _cut(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, 2, SLICE):
        s = Sentences(batch.column(2))
        a, b = s.runs(words)
        ids, copies, spans = (batch.column(i).to_pylist() for i in (0, 1, 3))
        out: list[tuple] = []
        for d, (doc, copy) in enumerate(zip(ids, copies)):
            lo, hi = int(s.first[d]), int(s.first[d + 1])
            gone = np.zeros(hi - lo, bool)
            if copy > 1:
                own = (a >= lo) & (a < hi)
                for x, y in zip(a[own] - lo, b[own] - lo):
                    gone[x:y + 1] = True
            for x in spans[d] or ():
                gone[x["start"]:x["end"]] = True
            text = s.raw[s.offsets[d]:s.offsets[d + 1]].tobytes()
            edges = [int(x - s.offsets[d]) for x in s.begin[lo:hi]] + [len(text)]
            kept = text if not gone.any() else text[:edges[0]] + b"".join(text[edges[i]:edges[i + 1]] for i in np.flatnonzero(~gone))
            out.append((None if doc == _LAST else doc, hi - lo, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                         names=["doc_id", "n_sentences", "n_removed", "kept_sha256", "text"])


def sentence_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept_sha256, text`` of each row; the
    text is what is left, to the byte."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed, _ = _keyed(docs, id_col, text_col)
    keyed = keyed.select("doc", "tie", "copy", "text")
    runs = keyed.where("copy = 1").select("doc", "tie", "text").mapInArrow(frugal(partial(_found, words=words)), _ROW).repartition(n, "gram")
    stretches = runs.mapInArrow(frugal(_repeated), "doc long, tie long, start long, end long")
    spans = stretches.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = keyed.join(spans, ["doc", "tie"], "left").select("doc", "copy", "text", "spans")
    return rows.mapInArrow(frugal(partial(_cut, words=words)), "doc_id long, n_sentences long, n_removed long, kept_sha256 string, text string")
