"""Operator 12: periodic runs, by Kruskal's algorithm over descending common prefixes.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends.  Suffixes of a text's words that share a long prefix
form classes; neighbours in suffix order are united by decreasing common prefix
(union-find, the smaller ordered set of positions into the larger).  When a
union at prefix ``l`` makes positions ``i`` and ``i + q`` neighbours and
``q <= l``, words ``i .. i + q + l`` have period ``q``, and no smaller one: a
smaller one would have put a position between the two, at a longer prefix.  The
seeds of one run share its end and period; the leftmost of them is its start.

A run of ``min_words`` words and two periods holds a pair with a prefix of half
of ``min_words`` at least, so only positions whose window of so many words is
found twice in the text take part.

Defined results: a null or empty text has no words and no runs; a null id stays
null; repeated rows give a row each; texts of any length are taken whole (a
text's suffix ranks need four bytes a word and doubling of its longest repeat);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postresp.llm.common import frugal, id_and_text, mix64, small_slices
from postresp.llm.spans import Hashes

MIN_WORDS = 12
SLICE = 4 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row.

    ``runs`` are structs (start, length, period) in words, by start and period,
    of ``max(min_words, 2 * period)`` words and more; ``collapsed`` is the text's
    words, joined by one blank, without those that stand in a run after its
    first period."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 1, SLICE):
            words = [t.encode().split() if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            start, length, period = find_runs(_symbols(words), offsets, min_words)
            doc = np.searchsorted(offsets, start, side="right") - 1
            counts = np.bincount(doc, minlength=len(words))
            runs = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(length), pa.array(period)], fields=list(_RUN)))
            for k in np.flatnonzero(counts).tolist():
                mine = doc == k
                words[k] = _collapse(words[k], start[mine] - offsets[k], length[mine], period[mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), runs, pa.array([b" ".join(w).decode() for w in words], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        frugal(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _symbols(texts: list[list[bytes]]) -> np.ndarray:
    """A number per word; equal only for equal words of one text, so that no
    common prefix passes the end of a text."""
    out, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.extend([base + seen.setdefault(w, len(seen)) for w in words])
        base += len(seen)
    return np.array(out, np.int64)


def find_runs(symbols: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period, over texts laid back to back."""
    least = max(1, (min_words + 1) // 2)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    held = np.zeros(len(offsets) - 1, bool)
    held[doc[_repeated_windows(symbols, least)]] = True
    origin = np.flatnonzero(held[doc])            # words of the texts in which a window is found twice
    found: dict[tuple[int, int], int] = {}
    if len(origin):
        places, levels = _classes(symbols[origin], least)
        common = _common_prefixes(symbols[origin], places, levels, least)
        _unite(places, common, least, min_words, found)
    rows = np.array([(s, e, q) for (e, q), s in found.items()], np.int64).reshape(-1, 3)
    start, period = origin[rows[:, 0]] if len(rows) else rows[:, 0], rows[:, 2]
    length = rows[:, 1] - rows[:, 0]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _repeated_windows(symbols: np.ndarray, least: int) -> np.ndarray:
    """Positions whose window of ``least`` words may be found elsewhere (by hash: never misses one)."""
    n = len(symbols) - least + 1
    if n < 2:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    keys = Hashes(mix64(symbols.astype(np.uint64) + np.uint64(1))).plain(at, at + least)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    return np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)


def _classes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions whose first ``least`` words are found again, in suffix order,
    and by depth (``least``, then doubled) the ranks of all positions: equal
    where that many words are equal, in order otherwise."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.full(least, -1)])
    order = np.lexsort([padded[k:k + n] for k in range(least - 1, -1, -1)])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([padded[order[1:] + k] != padded[order[:-1] + k] for k in range(least)])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = np.empty(n, np.int32 if n < 2**31 else np.int64)
    ranks[order] = first
    places = order[_shared(first)]
    levels = [(least, ranks.copy())]
    depth, active = least, places
    while len(active):
        after = active + depth
        follow = np.where(after < n, ranks[np.minimum(after, n - 1)], -1)
        order = np.lexsort((follow, ranks[active]))
        active, follow = active[order], follow[order]
        old = ranks[active]
        at = np.arange(len(active))
        head = np.ones(len(active), bool)
        head[1:] = old[1:] != old[:-1]
        new = head.copy()
        new[1:] |= follow[1:] != follow[:-1]
        ranks[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        depth *= 2
        active = active[_shared(ranks[active])]
        if len(active):
            levels.append((depth, ranks.copy()))
    return places[np.argsort(ranks[places], kind="stable")], levels


def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
    same = np.zeros(len(sorted_ranks) + 1, bool)
    same[1:-1] = sorted_ranks[1:] == sorted_ranks[:-1]
    return same[:-1] | same[1:]


def _common_prefixes(symbols: np.ndarray, places: np.ndarray, levels: list[tuple[int, np.ndarray]], least: int) -> np.ndarray:
    """Common prefix, in words, of each suffix and the one before it in suffix order (0 across classes)."""
    a, b = places[:-1], places[1:]
    n = len(symbols)
    common = np.zeros(len(a), np.int64)

    def step(values: np.ndarray, words: int, alive: np.ndarray) -> np.ndarray:
        i, j = a + common, b + common
        equal = alive & (i < n) & (j < n)
        equal[equal] = values[i[equal]] == values[j[equal]]
        common[equal] += words
        return equal

    every = np.ones(len(a), bool)
    for depth, ranks in reversed(levels):
        step(ranks, depth, every)
    alive = common >= least
    for _ in range(least - 1):
        alive = step(symbols, 1, alive)
    return np.concatenate([[0], common])


def _unite(places: np.ndarray, common: np.ndarray, least: int, min_words: int, found: dict[tuple[int, int], int]) -> None:
    """Kruskal over neighbours in suffix order, longest common prefix first;
    ``found`` maps (end, period) to the leftmost start of a run."""
    links = np.flatnonzero(common >= least)
    links = links[np.argsort(-common[links], kind="stable")]
    prefix = common[links].tolist()
    parent = list(range(len(places)))
    members: list[list[int] | None] = [[p] for p in places.tolist()]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def seed(left: int, right: int, shared: int) -> None:
        period = right - left
        if period <= shared and period + shared >= min_words:
            key = (right + shared, period)
            if found.get(key, right) > left:
                found[key] = left

    for k, shared in zip(links.tolist(), prefix):
        big, small = root(k - 1), root(k)
        if len(members[big]) < len(members[small]):
            big, small = small, big
        into, more = members[big], members[small]
        parent[small], members[small] = big, None
        if len(more) > 64 and len(more) * 8 > len(into):
            into = members[big] = sorted(into + more)
        else:
            for p in more:
                into.insert(bisect_left(into, p), p)
        for m, p in enumerate(more):          # neighbours that came from different sets
            at = bisect_left(into, p)
            if at and not (m and into[at - 1] == more[m - 1]):
                seed(into[at - 1], p, shared)
            if at + 1 < len(into) and not (m + 1 < len(more) and into[at + 1] == more[m + 1]):
                seed(p, into[at + 1], shared)
