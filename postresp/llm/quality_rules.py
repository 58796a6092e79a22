"""Quality rules with cross-document line frequency (operator 10).

Every line is normalised (words, A-Z lower-cased, joined by one blank) and
hashed; the number of different documents per host that hold it is counted
over the whole table.  Lines above the limit of their host are removed, and a
document that keeps too small a part of its words is rejected, as is one that
fails the base rules.  Copies of one text count as one document, in a line's
count and in its host's: they are left to de-duplication.

Defined results: null and empty texts have no word and fail; a null host is a
host of its own; lines without a word are never counted, compared or removed;
repeated rows get equal results; an empty table gives an empty result; other
columns are kept by ``quality_filter`` and ignored by ``quality_rules``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postresp.llm.common import frugal, mix64, small_slices, text_bytes
from postresp.llm.spans import IS_SPACE, LOWER, Hashes, counts_per, line_spans, owners, repeated, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in FEATURES) + ", base_failed boolean, kept boolean"
SLICE = 1 << 20


@dataclass(frozen=True)
class Rules:
    min_words: int = 50                #: fewer words fail
    max_repeat_percent: int = 50       #: more repeated words than this fail
    min_line_docs: int = 20            #: a line in this many documents of a host, or fewer, stays
    max_line_share: float = 0.05       #: and so does one in this share of the host's different documents, or less
    min_left_share: float = 0.3        #: a document that keeps a smaller share of its words is rejected
    max_broadcast_lines: int = 1 << 20  #: more lines above the limit than this are joined, not broadcast


class Parsed:
    """Words and lines of a batch of texts."""

    def __init__(self, texts: pa.Array, hosts: np.ndarray):
        self.raw, self.offsets = text_bytes(texts)
        self.n = len(texts)
        self.starts, self.ends = word_spans(self.raw, self.offsets)
        self.doc = owners(self.starts, self.offsets)
        line_from, line_to = line_spans(self.raw, self.offsets)
        first = np.searchsorted(self.starts, line_from)
        last = np.searchsorted(self.starts, line_to)
        full = last > first
        self.line_from, self.line_to = line_from[full], line_to[full]
        self.line_words = (last - first)[full]
        self.line_doc = owners(self.line_from, self.offsets)
        lower = Hashes.of_bytes(LOWER[self.raw])(self.starts, self.ends)
        normal = Hashes(lower)(first[full], last[full])
        self.key = mix64(normal ^ hosts.view(np.uint64)[self.line_doc]).view(np.int64)

    def features(self) -> dict[str, np.ndarray]:
        exact = Hashes.of_bytes(self.raw)
        words = exact(self.starts, self.ends)
        shown = (self.raw & 0xC0) != 0x80            # one byte of each code point
        docs = owners(np.arange(len(self.raw)), self.offsets) if len(self.raw) else np.zeros(0, np.int64)
        _, dup = repeated(self.line_doc, exact(self.line_from, self.line_to))
        covered = np.zeros(len(words) + 2, bool)
        if len(words) >= 3:
            inside = self.doc[2:] == self.doc[:-2]
            windows = Hashes(words)
            at = np.flatnonzero(inside)
            many, _ = repeated(self.doc[at], windows(at, at + 3))
            for k in range(3):
                covered[at[many] + k] = True
        return {"n_words": counts_per(self.doc, self.n),
                "word_chars": counts_per(docs[shown & ~IS_SPACE[self.raw]], self.n),
                "n_symbols": counts_per(docs[_SYMBOL[self.raw]], self.n),
                "n_dup_lines": counts_per(self.line_doc[dup], self.n),
                "n_repeat_words": counts_per(self.doc[covered[:len(words)]], self.n)}


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Rows as (text, host hash, content hash, whole row)."""
    return docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.col(host_col).isNull()).alias("host"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("content"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.struct("*").alias("row"))


def common_lines(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                 host_col: str = "source") -> DataFrame:
    """``key, host, n_docs``: lines in more documents of a host than allowed.

    Two aggregations, both combined before their shuffle: distinct
    (line, text) first, so that a line found everywhere is spread over all
    tasks, then the count per line; likewise for the texts of a host.
    """
    keyed = _keyed(docs, id_col, text_col, host_col)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 0, SLICE):
            hosts = batch.column(1).to_numpy()
            p = Parsed(batch.column(0), hosts)
            _, later = repeated(p.line_doc, p.key.view(np.uint64))
            doc = p.line_doc[~later]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.key[~later]), pa.array(hosts[doc]), pa.array(batch.column(2).to_numpy()[doc])],
                names=["key", "host", "content"])

    found = keyed.select("text", "host", "content").mapInArrow(frugal(lines), "key long, host long, content long")
    counted = (found.groupBy("key").agg(F.min("host").alias("host"), F.countDistinct("content").alias("n_docs"))
               .where(F.col("n_docs") > rules.min_line_docs))
    sizes = keyed.groupBy("host").agg(F.countDistinct("content").alias("host_docs"))
    return (counted.join(sizes, "host").where(F.col("n_docs") > F.col("host_docs") * rules.max_line_share)
            .select("key", "host", "n_docs"))


def _decide(p: Parsed, bad: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    out = p.features()
    out["removed_words"] = counts_per(p.line_doc[bad], p.n, p.line_words[bad])
    n = out["n_words"]
    out["base_failed"] = (n < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n)
    out["kept"] = ~out["base_failed"] & (n - out["removed_words"] >= rules.min_left_share * n)
    return out


def _applied(docs: DataFrame, rules: Rules, id_col: str, text_col: str, host_col: str, judge, schema: str) -> DataFrame:
    """Run ``judge(batch, parsed, is line above the limit)`` over all rows.

    Up to ``max_broadcast_lines`` line keys (8 bytes each) are broadcast;
    beyond that each document's own keys are joined to it.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col, host_col)
    # few rows: lines above the limit only; kept because they are counted, then used
    frequent = common_lines(docs, rules, id_col, text_col, host_col).select("key").persist()
    few = frequent.limit(rules.max_broadcast_lines + 1).count() <= rules.max_broadcast_lines
    if few:
        shared = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in frequent.toLocalIterator()], np.int64)))
        frequent.unpersist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_slices(batches, 0, SLICE):
                p = Parsed(batch.column(0), batch.column(1).to_numpy())
                yield judge(batch, p, np.isin(p.key, shared.value))

        return keyed.mapInArrow(frugal(run), schema)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 0, SLICE):
            p = Parsed(batch.column(0), batch.column(1).to_numpy())
            _, later = repeated(p.line_doc, p.key.view(np.uint64))
            doc = p.line_doc[~later]
            yield pa.RecordBatch.from_arrays([pa.array(p.key[~later])] + [pa.array(batch.column(c).to_numpy()[doc]) for c in (1, 2)],
                                             names=["key", "host", "content"])

    # the keys depend on host and text alone, so equal texts share one list
    lists = (keyed.select("text", "host", "content").mapInArrow(frugal(own), "key long, host long, content long")
             .distinct().join(frequent, "key", "left_semi")
             .groupBy("host", "content").agg(F.collect_list("key").alias("bad_keys")))
    joined = keyed.join(lists, ["host", "content"], "left").select("text", "host", "content", "doc_id", "row", "bad_keys")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 0, SLICE):
            p = Parsed(batch.column(0), batch.column(1).to_numpy())
            pairs = [(i, k) for i, ks in enumerate(batch.column(5).to_pylist()) for k in ks or ()]
            mark = {x for x in pairs}
            bad = np.fromiter(((int(d), int(k)) in mark for d, k in zip(p.line_doc, p.key)), bool, len(p.key))
            yield judge(batch, p, bad)

    return joined.mapInArrow(frugal(run_joined), schema)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: features, ``base_failed`` and ``kept``."""

    def judge(batch: pa.RecordBatch, p: Parsed, bad: np.ndarray) -> pa.RecordBatch:
        out = _decide(p, bad, rules)
        names = [*FEATURES, "base_failed", "kept"]
        return pa.RecordBatch.from_arrays([batch.column(3)] + [pa.array(out[c]) for c in names], names=["doc_id", *names])

    return _applied(docs, rules, id_col, text_col, host_col, judge, SCHEMA)


def quality_filter(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source") -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines above the limit
    (an integer column ``n_chars`` follows the text)."""

    def judge(batch: pa.RecordBatch, p: Parsed, bad: np.ndarray) -> pa.RecordBatch:
        kept = _decide(p, bad, rules)["kept"]
        texts = batch.column(0).to_pylist()
        for d in np.unique(p.line_doc[bad]):
            own = iter(bad[p.line_doc == d])
            texts[d] = "\n".join(x for x in texts[d].split("\n") if not (_has_word(x) and next(own)))
        row = batch.column(4)
        fields = [row.type.field(i) for i in range(row.type.num_fields)]
        new = {text_col: texts, "n_chars": [None if x is None else len(x) for x in texts]}
        columns = [pa.array(new[f.name], f.type) if f.name in new and (f.name == text_col or pa.types.is_integer(f.type))
                   else row.field(i) for i, f in enumerate(fields)]
        out = pa.StructArray.from_arrays(columns, fields=fields)
        return pa.RecordBatch.from_arrays([out], names=["row"]).filter(pa.array(kept))

    schema = T.StructType([T.StructField("row", docs.schema)])
    return _applied(docs, rules, id_col, text_col, host_col, judge, schema).select("row.*")


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\x0b\x0c\r"))
