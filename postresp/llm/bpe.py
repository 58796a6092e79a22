"""BPE encoding and decoding (operator 9).

A word is a doubly linked list of symbols; a priority queue holds the merge
rank of every neighbouring pair.  The lowest rank is taken first, leftmost on
ties; entries whose symbols have changed since they were queued are stale and
skipped.  Ids decode by concatenating vocabulary strings (joined as the file's
decoder says).  Words are encoded once per worker and remembered in a bounded
memo, so a corpus pays for its different words.

Defined results: null and empty texts have no ids and decode to the empty
string; repeated rows are encoded one by one; whole texts are processed; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postresp.llm.common import frugal, id_and_text, small_slices
from postresp.llm.token_counts import byte_alphabet, tokenizer_path

#: white space of the file's patterns (Unicode White_Space)
_WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPLIT = re.compile(f"[{_WHITE}]+").split
SLICE = 4 << 20
MEMO_SIZE = 120_000

TYPES = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(),
         "decoded_sha256": pa.string()}
SQL_TYPES = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


@lru_cache(maxsize=1)
def unicode_rules() -> tuple[dict[str, str], dict[int, str]]:
    """Character classes of letters and numbers, and the lower-case letters that
    differ from Python's, in the Unicode version of the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    classes = {}
    for category in "LN":
        runs = Split(Regex(rf"\p{{{category}}}+"), "removed", invert=True).pre_tokenize_str("".join(points))
        classes[category] = "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" for r, _ in runs)
    lowered = Lowercase().normalize_str("\n".join(c for c in points if c != "\n")).split("\n")
    return classes, {ord(c): x for c, x in zip((c for c in points if c != "\n"), lowered) if c.lower() != x}


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges by rank, lowest first and leftmost among equals.

    ``ranks`` maps ``left << 20 | right`` to a rank, ``merged`` a rank to the
    new symbol.  ``pair[i]`` is the rank of the pair that now begins at ``i``
    (-1: none); a queue entry, ``rank << shift | i``, is stale when it differs.
    """
    n = len(symbols)
    get = ranks.get
    pair = [get(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
    shift = 13 if n < 8192 else 40
    queue = [r << shift | i for i, r in enumerate(pair) if r >= 0]
    if not queue:
        return symbols
    heapify(queue)
    mask = (1 << shift) - 1
    pair.append(-1)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        i = entry & mask
        rank = entry >> shift
        if pair[i] != rank:
            continue
        j = after[i]
        new = symbols[i] = merged[rank]
        pair[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair[i] = r = get(new << 20 | symbols[k], -1)
            if r >= 0:
                heappush(queue, r << shift | i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = r = get(symbols[h] << 20 | new, -1)
            if r >= 0:
                heappush(queue, r << shift | h)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class Memo(dict):
    """Remembers a function's results; bounded: a full memo starts anew, but
    what is used again is taken over from the last one."""

    def __init__(self, function: Callable[[str], str], size: int = MEMO_SIZE):
        super().__init__()
        self.function, self.size, self.last = function, size, {}

    def __missing__(self, key: str) -> str:
        if len(self) >= self.size:
            self.last = dict(self)
            self.clear()
        value = self.last.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of a BPE file whose words end in a suffix."""

    def __init__(self, path: str, rules: tuple):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("expected a BPE file with word ends, composed lower-cased text and no decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        # ids of all bytes, within a word and at its end
        self.inner = {b: self.vocab[c] for c, b in byte_alphabet().items()}
        self.last = {b: self.vocab[c + self.suffix] for c, b in byte_alphabet().items()}
        classes, self.lower = rules
        letter, number = classes["L"], classes["N"]
        self.odd_points = np.zeros(sys.maxunicode + 1, bool)
        self.odd_points[list(self.lower)] = True
        self.plain_ascii = not self.odd_points[:128].any()
        # the file's alternatives; no two begin with the same character, so their order is free
        self.words = re.compile(rf"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{_WHITE}{letter}{number}]+").findall
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.ids = Memo(self._chunk)            # ids of remembered chunks, as text
        self.by_text = {str(i): s for i, s in self.strings.items()}

    @staticmethod
    def chunks(text: str) -> list[str]:
        # str.split also cuts at four separators that are no white space here
        return text.split() if not any(c in text for c in _SEPARATORS) else [c for c in _SPLIT(text) if c]

    def odd(self, text: str) -> bool:
        """Whether Python lowers a character of ``text`` in another way than the file's normaliser."""
        return bool(self.odd_points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merge_symbols(symbols, self.ranks, self.merged)

    def normalised(self, text: str) -> str:
        if text.isascii() and self.plain_ascii:
            return text.lower()
        # per character, as the file's normaliser does: a final sigma is no special case
        text = unicodedata.normalize("NFC", text).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
        return (text.translate(self.lower) if self.odd(text) else text).lower()

    def _chunk(self, chunk: str) -> str:
        """Ids, as text, of a stretch without white space."""
        return " ".join([str(i) for w in self.words(chunk) for i in self.word(w)])

    def encode_text(self, text: str) -> list[str]:
        """Ids of each chunk in order, as text.  No token reaches across white space."""
        if not any(s in text for s in self.special):
            return list(map(self.ids.__getitem__, self.chunks(self.normalised(text))))
        out = []
        for part in self.parts(text):
            if part in self.special:
                out.append(str(self.special[part]))
            else:
                out += map(self.ids.__getitem__, self.chunks(self.normalised(part)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.encode_text(text) for i in c.split()]

    def decode_text(self, ids: str) -> str:
        """``decode`` of ids given as text."""
        return " ".join(map(self.by_text.__getitem__, ids.split()))

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of all ids, joined by blanks (the file names no decoder)."""
        return " ".join(self.strings[i] for i in ids)


_CODECS: dict[str, Codec] = {}


def codec(path: str, rules: tuple | None = None) -> Codec:
    """The worker's codec of a file; ``rules`` are worked out once, by the driver."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, rules or unicode_rules())
    return _CODECS[path]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def bpe_encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", outputs: tuple[str, ...] = ("ids",),
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the asked ``outputs`` of each row: ``ids``, ``n_tokens``,
    ``decoded`` (the ids decoded again), and their SHA-256 digests."""
    path, rules = tokenizer_path(tokenizer), unicode_rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, rules)
        for batch in small_slices(batches, 1, SLICE):
            made: dict[str, list] = {name: [] for name in outputs}
            for text in batch.column(1).to_pylist():
                chunks = c.encode_text(text or "")
                ids = " ".join(chunks)
                if "ids" in made:
                    made["ids"].append([int(i) for i in ids.split()])
                if "n_tokens" in made:
                    made["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                if "ids_sha256" in made:
                    made["ids_sha256"].append(_digest(ids))
                if "decoded" in made or "decoded_sha256" in made:
                    decoded = c.decode_text(ids)
                    if "decoded" in made:
                        made["decoded"].append(decoded)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(_digest(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(made[o], TYPES[o]) for o in outputs],
                                             names=["doc_id", *outputs])

    schema = "doc_id long, " + ", ".join(f"{o} {SQL_TYPES[o]}" for o in outputs)
    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(run), schema)


def bpe_decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of each row of ids; null ids decode to the empty
    string, an id outside the vocabulary is an error."""
    path, rules = tokenizer_path(tokenizer), unicode_rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, rules)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.string())],
                    names=["doc_id", "decoded"])

    return (encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids")
            .mapInArrow(frugal(run), "doc_id long, decoded string"))
