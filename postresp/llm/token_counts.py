"""Token counts (operator 4).

Batch encoding inside an Arrow function that returns lengths only.  Texts are
cut into pieces of bounded size at boundaries no token can cross, and pieces
are gathered into batches of about equal bytes, so one long text neither
stalls a batch nor needs its ids in memory.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted one by one; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from postresp.llm.common import frugal, id_and_text, small_slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: a single blank between two characters that are not white space: in byte-level
#: patterns a token can only begin there, never reach across it
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    """A file path as given, or the place of a public vocabulary file."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(text: str, size: int) -> list[str]:
    """Cut a text into pieces of at most about ``size`` characters at safe
    boundaries; a stretch without one stays whole."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _BOUNDARY.search(text, start + size)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def _byte_level(spec: dict):
    """A rank encoder with the file's own vocabulary, when its merges are in id
    order (then rank order and id order are the same); else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("end_of_word_suffix"):
        return None
    vocab, byte_of = model["vocab"], byte_alphabet()
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    import public_tokenizers
    import tiktoken
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), list(special)


@lru_cache(maxsize=4)
def length_counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(a function from a batch of texts to their token counts, whether texts
    may be cut at the safe boundaries before)."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)], False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def by_library(batch: list[str]) -> list[int]:
        return [len(x) for x in library.encode_batch_fast(batch, add_special_tokens=False)]

    if (fast := _byte_level(spec)) is None:
        return by_library, False
    ranks, special = fast

    def by_ranks(batch: list[str]) -> list[int]:
        out = []
        for text in batch:
            try:
                if any(s in text for s in special):
                    out.append(len(ranks.encode(text, allowed_special="all")))
                else:
                    out.append(len(ranks.encode_ordinary(text)))
            except BaseException as e:  # the pattern engine gives up on huge runs of one class
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                out.extend(by_library([text]))
        return out

    return by_ranks, True


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", batch_bytes: int = 1 << 20,
                 piece_chars: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row of ``docs``.

    ``tokenizer`` is a path or the name of a public vocabulary file; each worker
    opens it once.  Texts are cut only for byte-level vocabularies, whose
    boundaries are known; others get whole texts.
    """
    path = tokenizer_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, cut = length_counter(path)
        for batch in small_slices(batches, 1, 8 * batch_bytes):
            texts = batch.column(1).to_pylist()
            totals, sizes = [0] * len(texts), [0] * len(texts)
            todo, owners, held = [], [], 0

            def flush() -> None:
                for i, n in zip(owners, counter(todo)):
                    totals[i] += n
                todo.clear()
                owners.clear()

            for i, text in enumerate(texts):
                if not text:
                    continue
                for piece in pieces(text, piece_chars) if cut else [text]:
                    n = len(piece.encode("utf-8"))
                    sizes[i] += n
                    todo.append(piece)
                    owners.append(i)
                    held += n
                    if held >= batch_bytes:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(count), SCHEMA)
