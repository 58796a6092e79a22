"""Operator 13: personal data, by rules and a linear-chain conditional random field.

The rules (``base_spans``) find e-mail addresses, IPv4 addresses, card and
telephone numbers in their plain forms.  A conditional random field over the
shapes of a line's tokens adds what they miss: numbers in national or spaced
form, addresses with spelt-out signs, and keys (``token = "..."``).  It is
trained by gradient steps on a small labelled table (``labelled_table``: fixed
sentences whose slots are filled by a seeded rule; at most ``MAX_LABELLED`` rows
are read) and decoded by Viterbi over batches of lines in numpy.

A token is a run of letters and digits or one other character; its shape is a
class of digits by number, letters by case, hexadecimal strings, a sign or a cue
word, and whether a blank stands before it.  Scores are sums over the shapes of
the token and of two to both sides.  A line in which no span can pay, by a bound on
what its labels gain over ``O`` (``Field.live_lines``), is not decoded.

Spans of the field that touch a span of the rules are left out (theirs stay), and
so are those that cannot be what their label says (``plausible``): a card's
digits pass the check sum, a telephone number has 7 to 15 digits.

Defined results: a null or empty text has no spans; a null id stays null;
repeated rows give a row each; texts and lines of any length are taken whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postresp.llm.common import frugal, id_and_text, small_slices, text_bytes
from postresp.llm.spans import IS_SPACE, LOWER, Hashes

SLICE = 4 << 20
MAX_LABELLED = 5000
SEED = 13
KINDS = ("email", "ip", "card", "phone", "key")
BASE_KINDS = KINDS[:4]

# ------------------------------------------------------------------ rules --

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins at the first digit of a run: from a later one it ends alike
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one pass: what stands before each ``@``, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        # a later local part begins after this sign, or after the match
        end = domain.end() if domain else at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules, in code points, by start and kind."""
    found = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return [(s, e, BASE_KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


# ----------------------------------------------------------------- shapes --

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CUES = ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "phone", "tel", "telephone", "call", "fax", "mobile", "mail", "email",
         "contact", "at", "dot", "card", "visa", "ip", "host", "server", "address", "version", "page", "pages", "isbn", "figure", "section", "year")
_SHAPES = (["edge", "other"] + [f"sign {c}" for c in _SIGNS] + [f"{n} digits" for n in ("1", "2", "3", "4", "5-6", "7-8", "9-11", "12-19", "20+")]
           + ["letter", "lower", "Capital", "UPPER", "miXed", "long", "hex", "code", "word1", "1mix"] + [f"cue {w}" for w in _CUES])
_CODE = {name: k for k, name in enumerate(_SHAPES)}
#: shapes count twice: with and without a blank before
N_SHAPES = 2 * len(_SHAPES)
REACH = 2
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
N_LABELS = len(LABELS)

_SIGN_CODE = np.full(256, _CODE["other"], np.int64)
for _c in _SIGNS:
    _SIGN_CODE[ord(_c)] = _CODE[f"sign {_c}"]
_IS_DIGIT, _IS_LOWER, _IS_UPPER, _IS_HEX = (np.zeros(256, bool) for _ in range(4))
_IS_DIGIT[48:58] = _IS_LOWER[97:123] = _IS_UPPER[65:91] = True
_IS_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
_IS_LOWER[128:] = True            # parts of other letters
_IS_WORD = _IS_DIGIT | _IS_LOWER | _IS_UPPER


@lru_cache(maxsize=1)
def _cues() -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(pa.array(_CUES))
    keys = Hashes.of_bytes(raw)(offsets[:-1], offsets[1:])
    order = np.argsort(keys)
    return keys[order], np.array([_CODE[f"cue {w}"] for w in _CUES])[order]


class Tokens:
    """Tokens of texts laid back to back: byte ``starts`` and ``ends``, ``shape``,
    and the ``lines`` (first tokens) they form; a line is a unit of decoding."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        word = _IS_WORD[raw]
        sign = ~word & ~IS_SPACE[raw]
        edge = offsets[(offsets > 0) & (offsets < len(raw))]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        begins[edge] = word[edge]
        stops[edge - 1] = word[edge - 1]
        self.starts = np.flatnonzero(begins | sign)
        self.ends = np.flatnonzero(stops | sign) + 1
        self.shape = self._shapes(raw)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        feeds = np.concatenate([[0], np.cumsum(raw == 10)])
        place = feeds[self.starts] + self.doc          # grows with every line and every text
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        self.lines = np.flatnonzero(first)
        self.line = np.cumsum(first) - 1

    def _shapes(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.int64)
        s, e = self.starts, self.ends
        n = e - s
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[raw])])[np.stack([s, e], 1)], axis=1)[:, 0]
        digits, lower, upper, hexes = map(count, (_IS_DIGIT, _IS_LOWER, _IS_UPPER, _IS_HEX))
        head = raw[s]
        out = _SIGN_CODE[head]
        of = lambda name: _CODE[name]
        letters = (digits == 0) & _IS_WORD[head]
        out = np.where(letters, of("miXed"), out)
        out = np.where(letters & (lower == n), of("lower"), out)
        out = np.where(letters & (upper == n), of("UPPER"), out)
        out = np.where(letters & (upper == 1) & _IS_UPPER[head], of("Capital"), out)
        out = np.where(letters & (n == 1), of("letter"), out)
        out = np.where(letters & (n > 30), of("long"), out)
        short = np.flatnonzero(letters & (n < 10))
        keys, codes = _cues()
        found = Hashes.of_bytes(LOWER[raw])(s[short], e[short])
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        out[short[hit]] = codes[at[hit]]
        mixed = (digits > 0) & (digits < n)
        out = np.where(mixed, np.where(_IS_DIGIT[head], of("1mix"), of("word1")), out)
        out = np.where(mixed & (n >= 12), of("code"), out)
        out = np.where((digits > 0) & (hexes == n) & (n >= 16) & mixed, of("hex"), out)
        number = digits == n
        sizes = np.searchsorted([1, 2, 3, 4, 6, 8, 11, 19], n)
        out = np.where(number, of("1 digits") + sizes, out)
        blank = np.ones(len(s), np.int64)
        blank[1:] = s[1:] > e[:-1]
        return 2 * out + blank


# ------------------------------------------------------------------- model --

@dataclass
class Field:
    """Weights: ``shape[d + REACH, c, y]`` of label y where the token at distance
    d has shape c; ``move[y, z]`` between labels; ``start[y]``."""

    shape: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def around(self, shape: np.ndarray, line: np.ndarray, d: int) -> np.ndarray:
        """Shapes of the tokens ``d`` further on; ``edge`` beyond the line."""
        out = np.zeros(len(shape), np.int64)
        if d == 0:
            return shape
        a, b = (slice(None, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(None, d))
        out[a] = np.where(line[a] == line[b], shape[b], 0)
        return out

    def scores(self, shape: np.ndarray, line: np.ndarray) -> np.ndarray:
        return sum(self.shape[d + REACH][self.around(shape, line, d)] for d in range(-REACH, REACH + 1))

    def live_lines(self, scores: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Lines in which a span can pay (never misses one).  A span of a kind is
        its B and some I's; it gains at most the best B of the line, with all that
        entering and leaving can add, and every I that gains."""
        base = self.move[0, 0]
        enter = np.maximum((self.move - base).max(0), self.start - self.start[0])[1:]
        leave = max(0.0, float((self.move[:, 0] - base).max()))
        gain = scores[:, 1:] - scores[:, :1] + enter.astype(np.float32)
        best = np.maximum.reduceat(gain[:, ::2], lines, axis=0) + leave + np.add.reduceat(np.maximum(gain[:, 1::2], 0), lines, axis=0)
        return (best > -1e-3).any(1)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Which labels follow each other, and which begin a line: an I only after its B or I."""
    move = np.ones((N_LABELS, N_LABELS), bool)
    for k in range(len(KINDS)):
        move[:, 2 * k + 2] = False
        move[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    start = np.ones(N_LABELS, bool)
    start[2::2] = False
    return move, start


def fit(sentences: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 200, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Most probable weights (with a Gaussian prior) by Adam over all labelled sentences at once."""
    raw, offsets = text_bytes(pa.array([s.replace("\n", " ") for s, _ in sentences]))
    t = Tokens(raw, offsets)
    gold = np.zeros(len(t.starts), np.int64)
    for k, (_, spans) in enumerate(sentences):
        mine = np.flatnonzero(t.doc == k)
        for s, e, kind in spans:                # the labelled sentences are ASCII
            inside = mine[(t.starts[mine] - offsets[k] >= s) & (t.ends[mine] - offsets[k] <= e)]
            gold[inside] = 2 + 2 * KINDS.index(kind)
            gold[inside[:1]] -= 1
    n, width = len(t.lines), int(np.bincount(t.line).max())
    where = np.full((n, width), -1)
    where[t.line, np.arange(len(t.line)) - t.lines[t.line]] = np.arange(len(t.line))
    real = where >= 0
    last = real.sum(1) - 1
    may_move, may_start = _allowed()
    field = Field(np.zeros((2 * REACH + 1, N_SHAPES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS))
    near = [field.around(t.shape, t.line, d) for d in range(-REACH, REACH + 1)]
    weights = [field.shape, field.move, field.start]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    pairs = np.flatnonzero(t.line[1:] == t.line[:-1])
    for turn in range(1, steps + 1):
        e = field.scores(t.shape, t.line)
        e = np.exp(e - e.max(1, keepdims=True))[where]              # (n, width, labels); only scaled
        move = np.where(may_move, np.exp(field.move), 0.0)
        begin = np.where(may_start, np.exp(field.start), 0.0)
        ahead = np.zeros((n, width, N_LABELS))
        back = np.ones((n, width, N_LABELS))
        ahead[:, 0] = begin * e[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for i in range(1, width):
            ahead[:, i] = (ahead[:, i - 1] @ move) * e[:, i]
            ahead[:, i] /= ahead[:, i].sum(1, keepdims=True)
        for i in range(width - 2, -1, -1):
            back[:, i] = (back[:, i + 1] * e[:, i + 1]) @ move.T
            back[:, i] /= back[:, i].sum(1, keepdims=True)
            back[i >= last, i] = 1.0
        one = ahead * back
        one /= one.sum(2, keepdims=True)
        two = np.zeros((N_LABELS, N_LABELS))
        for i in range(width - 1):
            live = i < last
            here, there = ahead[live, i], (back[:, i + 1] * e[:, i + 1])[live]
            two += move * ((here / ((here @ move) * there).sum(1, keepdims=True)).T @ there)
        differ = -one[real][np.argsort(where[real])]
        differ[np.arange(len(gold)), gold] += 1
        g_shape = np.zeros_like(field.shape)
        for d, ids in enumerate(near):
            for y in range(N_LABELS):
                g_shape[d, :, y] = np.bincount(ids, differ[:, y], N_SHAPES)
        g_move = -two
        np.add.at(g_move, (gold[pairs], gold[pairs + 1]), 1)
        g_start = differ[t.lines].sum(0)
        for w, g, m, v in zip(weights, (g_shape, g_move, g_start), first, second):
            g = g - penalty * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    field.move[~may_move] = -np.inf
    field.start[~may_start] = -np.inf
    field.shape = field.shape.astype(np.float32)
    return field


def viterbi(field: Field, scores: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Best labels of all tokens; ``lines``: first token of each line.  All lines
    that have an i-th token take their i-th step together."""
    n = len(scores)
    sizes = np.diff(np.append(lines, n))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = lines[order], sizes[order]
    came = np.zeros((n, N_LABELS), np.int8)
    best = field.start + scores[first]
    final = np.zeros(len(first), np.int64)
    left = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    for i in range(1, len(left)):
        live = left[i]
        if live < len(best):                    # lines that ended
            final[live:len(best)] = best[live:].argmax(1)
            best = best[:live]
        at = first[:live] + i
        ways = best[:, :, None] + field.move
        step = ways.argmax(1)
        came[at] = step
        best = np.take_along_axis(ways, step[:, None, :], 1)[:, 0] + scores[at]
    if len(sizes):
        final[:len(best)] = best.argmax(1)
    labels = np.zeros(n, np.int64)
    now = np.zeros(0, np.int64)
    for i in range(len(left) - 1, -1, -1):
        live = left[i]
        now = np.concatenate([now, final[len(now):live]])
        at = first[:live] + i
        labels[at] = now
        now = came[at, now].astype(np.int64)
    return labels


_SPELT = re.compile(r"(?i)(?<![a-z])at(?![a-z]).*(?:(?<![a-z])dot(?![a-z])|\.[a-z])")


def plausible(kind: str, text: str) -> bool:
    """Can this be what the field says it is?"""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)
    if kind == "email":
        return "@" in text or bool(_SPELT.search(text))
    return len(text) >= 8


def field_spans(field: Field, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, byte start, byte end, kind) of the spans the field finds."""
    t = Tokens(raw, offsets)
    none = np.zeros(0, np.int64)
    if not len(t.starts):
        return none, none, none, none
    scores = field.scores(t.shape, t.line)
    kept = np.flatnonzero(field.live_lines(scores, t.lines)[t.line])
    if not len(kept):
        return none, none, none, none
    line = t.line[kept]
    lines = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    labels = viterbi(field, scores[kept], lines)
    begins = np.flatnonzero(labels % 2 == 1)
    outside = np.append(np.flatnonzero((labels == 0) | (labels % 2 == 1) | np.isin(np.arange(len(labels)), lines)), len(labels))
    ends = outside[np.searchsorted(outside, begins, side="right")] - 1
    return t.doc[kept[begins]], t.starts[kept[begins]], t.ends[kept[ends]], (labels[begins] - 1) // 2


# --------------------------------------------------------- labelled table --

# Fixed sentences.  {slots} are filled by a seeded rule; a slot named for a kind is labelled with it.
SENTENCES = (
    "Please call {phone} today.", "Tel. {phone}", "phone: {phone}, ask for {name}", "Mobile {phone} or {phone}", "You can reach us at {phone} from 9 to 5.",
    "fax {phone}; office {n2}", "Contact {name} ({phone}) before {date}.", "{words} {phone} {words}", "{words}, {phone}.",
    "Write to {email} soon.", "email: {email}", "Mail {email} or call {phone}.", "{words} {email} {words}", "contact {name}, {email}, for more.",
    "The server {ip} is down.", "host {ip} port {n4}", "{words} {ip} {words}", "from {ip} to {ip} in {n2} ms", "{words} {ip}{junk}",
    "card {card} exp {n2}/{n2}", "Visa {card}", "{words} {card} {words}", "pay with {card}, please", "number {card}.", "{junk}{card}{junk}",
    'token = "{key}"', "api_key: {key}", 'secret="{key}" {words}', "password = {key}", "{words} token = \"{key}\"", "export KEY={key}", "{words}. Key: {key} {words}.",
    # nothing to find
    "{words}.", "{words}, {words}.", "{words}; {words}!", "{Words} ({words}) {words}?", "{words} at the {words}.", "{Words} at {words}. At at {words}.", "{Words} at {words}. {Words} at {words}, at {words}.", "{words} dot {words} at {words}.",
    "Version {n1}.{n1}.{n1} of {date}.", "see pages {n2}-{n2} and section {n1}.{n1}.{n2}", "In {year}, {n2} people paid ${n1},{n3}.{n2}.", "{junk} {words} {junk}",
    "ISBN {n3}-{n1}-{n2}-{n6}-{n1}", "between {year} and {year}", "call me at {n1} or at {n2}:{n2}", "The key to {words} is {words}.", "token ring, {words}",
    "on page {n3} figure {n1} shows {n3} {words}", "{n1}. {words}\t{n2}. {words}", "order {n6}, {n4} items, {n2}%", "version {n1}.{n1}", "license CC BY-NC {n1}.{n1}",
    "{date} {n2}:{n2}:{n2} {words}", "the password is {words}", "a secret {words}, a card {words}", "{n3},{n3},{n3} {words}", "{words} \"{words}\" = {words}",
    "{WORDS}!! {WORDS}!! {words}", "{words}{junk}{words}", "phone {words}, email {words}, host {words}", "+{n2} {words}", "({n3}) {words}", "{word1} {words} {word1}",
)


def _fill(rng: np.random.Generator, slot: str) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 10)))
    if slot == "phone":
        return pick(lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
                    lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(2)} {digits(4)} {digits(4)}", lambda: f"0{digits(3)} {digits(3)} {digits(3)}",
                    lambda: f"+{digits(2)} {digits(3)} {digits(7)}", lambda: f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: f"0{digits(3)}/{digits(6)}",
                    lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"+{digits(2)}-{digits(3)}-{digits(3)}-{digits(3)}")()
    if slot == "email":
        return pick(lambda: f"{word()}.{word()}@{word()}.{pick('org', 'com', 'example')}", lambda: f"{word()}{digits(2)}@{word()}{digits(1)}.example.org",
                    lambda: f"{word()} at {word()} dot {pick('org', 'com', 'net')}", lambda: f"{word()} [at] {word()} [dot] {pick('org', 'com', 'net')}",
                    lambda: f"{word()} (at) {word()} (dot) {pick('de', 'fr', 'com')}", lambda: f"{word()} dot {word()} at {word()} dot {pick('org', 'com')}")()
    if slot == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if slot == "card":
        return pick(lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)),
                    lambda: ".".join(digits(4) for _ in range(4)), lambda: digits(15))()
    if slot == "key":
        return pick(lambda: "".join(rng.choice(list("0123456789abcdef"), pick(32, 40, 24))), lambda: "".join(rng.choice(list("0123456789abcdefABCDEFGHkmnpqrstuvwxyz"), 20)),
                    lambda: "".join(rng.choice(list("0123456789abcdef"), 32)))()
    if slot[0] == "n" and slot[1:].isdigit():
        return digits(int(slot[1:]))
    return {"name": lambda: f"{word().capitalize()} {word().capitalize()}", "words": lambda: " ".join(word() for _ in range(rng.integers(1, 9))),
            "Words": lambda: " ".join(word() for _ in range(rng.integers(1, 6))).capitalize(), "WORDS": lambda: word().upper(),
            "date": lambda: pick(f"{pick(19, 20)}{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}"),
            "year": lambda: f"{pick(19, 20)}{digits(2)}", "junk": lambda: pick("###", "%%%", "$$$", "&&&", "***", "|||", "<<>>", "#", "..", "--"),
            "word1": lambda: f"{word()}{digits(pick(1, 2, 3))}"}[slot]()


def labelled_table(spark: SparkSession, copies: int = 14, seed: int = SEED) -> DataFrame:
    """``sentence, spans``: every fixed sentence ``copies`` times, slots filled anew."""
    rng, rows = np.random.default_rng(seed), []
    for sentence in SENTENCES * copies:
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", sentence):
            if part[:1] == "{":
                value = _fill(rng, part[1:-1])
                if part[1:-1] in KINDS:
                    spans.append((len(text), len(text) + len(value), part[1:-1]))
                part = value
            text += part
        rows.append((text, spans))
    return spark.createDataFrame(rows, "sentence string, spans array<struct<start:long,end:long,kind:string>>")


def fit_table(labelled: DataFrame, **how) -> Field:
    """The field fitted to a labelled table of at most ``MAX_LABELLED`` rows (the first by sentence)."""
    rows = labelled.orderBy("sentence").limit(MAX_LABELLED).collect()
    return fit([(r.sentence, [tuple(s) for s in r.spans]) for r in rows], **how)


# ---------------------------------------------------------------- operator --

def _added(field: Field, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, end, kind) of the field, in code points."""
    raw, offsets = text_bytes(column)
    doc, start, end, kind = field_spans(field, raw, offsets)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for d, s, e, k in zip(doc.tolist(), (points[start] - points[offsets[doc]]).tolist(), (points[end] - points[offsets[doc]]).tolist(), kind.tolist()):
        found.setdefault(d, []).append((s, e, k))
    return found


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, masked`` of each row: ``spans`` are structs (kind, start,
    end, base) in code points, by start and kind; ``masked`` is the text with
    each span (of overlapping ones the first) replaced by its kind in brackets."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, 1, SLICE):
            added = _added(model.value, batch.column(1))
            spans, masked = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                rules = base_spans(text or "")
                every = [(s, KINDS.index(kind), e, True) for s, e, kind in rules]
                every += [(s, kind, e, False) for s, e, kind in added.get(k, [])
                          if not any(s < b and a < e for a, b, _ in rules) and plausible(KINDS[kind], text[s:e])]
                every.sort()
                spans.append([{"kind": KINDS[kind], "start": s, "end": e, "base": base} for s, kind, e, base in every])
                masked.append(_mask(text, every))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(masked, pa.string())], names=["doc_id", "spans", "masked"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        frugal(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>, masked string")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _mask(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    if not spans:
        return text
    parts, end = [], 0
    for s, kind, e, _ in spans:
        if s >= end:
            parts += [text[end:s], f"[{KINDS[kind]}]"]
            end = e
    return "".join([*parts, text[end:]])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
