"""Column expressions for cleaning post text.

All steps are built-in ``regexp_replace`` / ``regexp_count`` /
``regexp_extract_all`` / higher-order array functions, so Catalyst collapses
the chain into one projection inside whole-stage codegen; no Python UDF.

Java regex notes
* ``(?U)`` (UNICODE_CHARACTER_CLASS) makes ``\\S``, ``\\w`` Unicode-aware the way
  Python's ``re`` is on ``str`` patterns.
* The link patterns use one character class for the tail instead of an
  alternation under ``+``: the alternation recurses per character in
  ``java.util.regex`` and overflows the stack on long tails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Link rules, in order: (prefix pattern, replacement).  The tail that follows
# each prefix is one or more characters of LINK_TAIL_COMPAT (the reference's
# class, which contains the range "$-_" and a space, so it swallows following
# words) or, with tail="nonspace", of \S.
LINK_RULES = [
    ("pic.twitter.com/", " _IMAGE"),
    ("https://pbs.twimg.com/media/", "IMAGE"),
    ("https://twitter.com", " _RETWEET"),
    ("http[s]?://", " _URL"),
    ("URL#", " _URL"),
]
LINK_TAIL_COMPAT = "[a-z$-_! ]+"
LINK_TAIL_NONSPACE = "(?U)\\S+"
# Repeat squeezing: unit followed by two or more copies -> the copies; 10 passes.
SQUEEZE_PATTERN = "(?U)(\\S+)(\\1{2,})"
SQUEEZE_REPLACEMENT = "$2"
SQUEEZE_PASSES = 10
# Account-specific boilerplate phrase removed before stripping.
BOILERPLATE_PHRASE = "_USArmy Posted... _URL …"
# Strip rules applied in order after the phrase: (pattern, replacement).
STRIP_RULES = [
    ("(?U)@\\S*", ""),
    ("(?U)_IMAGE\\S*", ""),
    ("…", ""),
    ("(?U)_URL\\S*", ""),
    ("(?U)_RETWEET\\S*", ""),
    ("(?U)http[s]?://(\\S+)", ""),
    ("\u00a0", ""),
    (" +", " "),
    ("-+", "-"),
    ("\\.+", "."),
    ("!+", "."),
    ("…*", ""),
]
# Patterns that give a rule's result without replacing a match by itself: a single
# character stays as it is.  The last rule finds nothing the third has left.
SAME_RULES = {" +": " {2,}", "-+": "-{2,}", "\\.+": "\\.{2,}"}
# What every match of a rule holds: a text without it is left as it is, unsearched.
RULE_HOLDS = {
    "pic.twitter.com/": "twitter", "https://pbs.twimg.com/media/": "https://pbs", "https://twitter.com": "https://twitter",
    "http[s]?://": "http", "URL#": "URL#", "(?U)@\\S*": "@", "(?U)_IMAGE\\S*": "_IMAGE", "…": "…", "(?U)_URL\\S*": "_URL",
    "(?U)_RETWEET\\S*": "_RETWEET", "(?U)http[s]?://(\\S+)": "http", "\u00a0": "\u00a0", " +": "  ", "-+": "--", "\\.+": "..", "!+": "!",
}
# Plain words: letters/digits not touching a quote, "=" or a word character.
WORD_PATTERN = "(?U)(?<![\"=\\w])[^\\W_]+(?![\"=\\w])"
# Minimum number of non-stop-word tokens a kept post must exceed.
TOKEN_THRESHOLD = 2
# Sentinel written in place of removed posts.
DELETE_SENTINEL = "DELETE"
# ---------------------------------------------------------------------------

# Whitespace / non-whitespace runs (their concatenation is the text).
RUN_PATTERN = "(?U)\\s+|\\S+"
# A run that contains a repeat: some unit followed by two copies.  A run of under
# twelve characters has no room for units of over three.
REPEAT_RUN_PATTERN = "(?U)(?<!\\S)(?:(?=\\S{12})(?=\\S*?(\\S+?)\\1\\1)|(?=\\S*?(\\S{1,3}?)\\2\\2))\\S++"
FENCE = "\u0001"
# Tokens: runs of letters/digits/underscore, or any single other non-space char.
TOKEN_PATTERN = "(?U)[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"


def _tail(tail: str) -> str:
    if tail == "compat":
        return LINK_TAIL_COMPAT
    if tail == "nonspace":
        return LINK_TAIL_NONSPACE
    raise ValueError(f"tail must be 'compat' or 'nonspace', got {tail!r}")


def _replace_where(c: Column, rule: str, pattern: str, repl: str) -> Column:
    """``pattern`` (of ``rule``) replaced in texts that hold what its matches hold;
    looking for that is far cheaper than a search by the pattern."""
    # the lambda's variable holds the text, computed once
    return F.get(F.transform(F.array(c), lambda t: F.when(t.contains(RULE_HOLDS[rule]), F.regexp_replace(t, pattern, repl)).otherwise(t)), F.lit(0))


def replace_links(c: Column, tail: str = "compat") -> Column:
    """Image / media / retweet / any link / URL# fragments -> tokens."""
    t = _tail(tail)
    for prefix, repl in LINK_RULES:
        c = _replace_where(c, prefix, prefix + t, repl)
    return c


def squeeze_repeats(c: Column, passes: int = SQUEEZE_PASSES) -> Column:
    """``(\\S+)(\\1{2,}) -> \\2`` repeated ``passes`` times.

    Works on units, not only letters (``hahahahaha`` -> ``haha``); long runs do
    not fully reach two copies within 10 passes, exactly like the reference.

    A match never crosses whitespace (unit and copies are ``\\S``), so only
    non-whitespace runs that contain a repeat get the passes -- same result as
    passing over the whole text.  One pass fences those runs with a character
    the text lacks; cut at the fences, every second piece is such a run.  A
    text's runs go through the passes together, one a line, so that a pass is
    one call a text and not one a run.  A pass that changes nothing is the last:
    those after it would change nothing either.
    """
    def chain(r, left=passes):
        if not left:
            return r
        return F.get(F.transform(F.array(r), lambda old: F.get(F.transform(
            F.array(F.regexp_replace(old, SQUEEZE_PATTERN, SQUEEZE_REPLACEMENT)),
            lambda new: F.when(new == old, new).otherwise(chain(new, left - 1))), F.lit(0))), F.lit(0))

    def fenced(pieces):
        runs = F.array_join(F.filter(pieces, lambda r, i: i % 2 == 1), "\n")
        return F.array_join(F.zip_with(F.filter(pieces, lambda r, i: i % 2 == 0), F.split(chain(runs), "\n"),
                                       lambda r, run: F.concat(r, F.coalesce(run, F.lit("")))), "")

    def of_text(t):
        every = F.regexp_extract_all(t, F.lit(RUN_PATTERN), 0)
        pieces = F.split(F.regexp_replace(t, REPEAT_RUN_PATTERN, f"{FENCE}$0{FENCE}"), FENCE)
        # a text that holds the fence itself is cut into all its runs
        return F.when(t.contains(FENCE), F.array_join(F.transform(every, lambda r: F.when(r.rlike(SQUEEZE_PATTERN), chain(r)).otherwise(r)), "")) \
            .otherwise(F.get(F.transform(F.array(pieces), fenced), F.lit(0)))

    # the variables of these lambdas hold a value used several times, computed once
    return F.get(F.transform(F.array(c), of_text), F.lit(0))


def remove_newlines(c: Column) -> Column:
    """Delete newline characters (no space is put in)."""
    return F.replace(c, F.lit("\n"), F.lit(""))


def clean_text(c: Column, tail: str = "compat", squeeze: bool = True) -> Column:
    """C1-C7 in reference order."""
    c = replace_links(c, tail)
    if squeeze:
        c = squeeze_repeats(c)
    return remove_newlines(c)


def strip_low_content(c: Column, phrase: str | None = BOILERPLATE_PHRASE) -> Column:
    """Remove mentions, link tokens, ellipses, nbsp; squeeze punctuation."""
    if phrase:
        c = F.replace(c, F.lit(phrase), F.lit(""))
    for pat, repl in STRIP_RULES[:-1]:
        c = _replace_where(c, pat, SAME_RULES.get(pat, pat), repl)
    return c


def tokenize(c: Column) -> Column:
    """Words (letters, digits, underscore) and single punctuation marks."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def count_content_tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Number of tokens that are not (case-sensitive) stop words.

    ``filter`` keeps repeated tokens; ``array_except`` would de-duplicate.
    """
    stop = stop_words if stop_words is not None else ENGLISH_STOP_WORDS
    # isin over a literal list becomes a hash-set lookup (InSet)
    return F.size(F.filter(tokenize(c), lambda t: ~t.isin(*stop)))


def count_plain_words(c: Column) -> Column:
    """C11: number of plain words (letters/digits not next to ``"``, ``=``, ``\\w``)."""
    return F.regexp_count(c, F.lit(WORD_PATTERN))


def has_plain_word(c: Column) -> Column:
    """C11 > 0: whether there is a plain word; the search ends at the first."""
    return c.rlike(WORD_PATTERN)


def keep_post(n_tokens: Column, n_words: Column | None,
              threshold: int = TOKEN_THRESHOLD) -> Column:
    """Keep iff content tokens > threshold and at least one plain word."""
    cond = n_tokens > F.lit(threshold)
    if n_words is not None:
        cond = cond & (n_words > F.lit(0))
    return cond


def collapse_spaces(c: Column) -> Column:
    """Squeeze runs of spaces into one space."""
    return _replace_where(c, " +", SAME_RULES[" +"], " ")


# ---------------------------------------------------------------------------
# Spark's built-in English stop-word list
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")), kept
# inline so SQL oracles and executors need no JVM call to get it.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd
we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't
hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
let's ought that's there's what's when's where's who's why's would
""".split()
# ---------------------------------------------------------------------------
