"""DuckDB (RE2) versions of the text expressions, for the oracle SQL.

RE2 has no back-references and no look-around, and its ``\\s`` / ``\\S`` are
ASCII.  So: Unicode whitespace is spelled out (Java ``(?U)\\s`` = the
White_Space property), squeezing (C6) has no SQL form, and plain-word
counting (C11) is rewritten: a plain word is a maximal letter/digit run whose
neighbours are not ``_``, ``"`` or ``=`` -- drop runs touching those, count
the rest.
"""

from __future__ import annotations

from postresp.functions import text as T

WS = r"\t\n\f\r \x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NON_WS = f"[^{WS}]"
ALNUM = r"[\p{L}\p{N}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"


def replace_links_sql(expr: str) -> str:
    for prefix, repl in T.LINK_RULES:
        expr = rx(expr, prefix + T.LINK_TAIL_COMPAT, repl)
    return expr


def clean_text_sql(expr: str) -> str:
    """C1-C5 + C7 (no squeeze)."""
    return f"replace({replace_links_sql(expr)}, chr(10), '')"


_STRIP_RE2 = [
    ("@" + NON_WS + "*", ""),
    ("_IMAGE" + NON_WS + "*", ""),
    ("…", ""),
    ("_URL" + NON_WS + "*", ""),
    ("_RETWEET" + NON_WS + "*", ""),
    ("http[s]?://(" + NON_WS + "+)", ""),
    (r"\x{A0}", ""),
    (" +", " "),
    ("-+", "-"),
    (r"\.+", "."),
    ("!+", "."),
    ("…*", ""),
]


def strip_sql(expr: str, phrase: str | None = T.BOILERPLATE_PHRASE) -> str:
    if phrase:
        expr = f"replace({expr}, {lit(phrase)}, '')"
    for pat, repl in _STRIP_RE2:
        expr = rx(expr, pat, repl)
    return expr


TOKEN_RE2 = r"[\p{L}\p{N}_]+|[^" + WS + r"\p{L}\p{N}_]"


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(TOKEN_RE2)})"


def content_tokens_sql(expr: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in T.ENGLISH_STOP_WORDS) + "]"
    return (f"CAST(len(list_filter({tokens_sql(expr)}, lambda t: NOT list_contains({stop}, t)))"
            " AS INTEGER)")


def plain_words_sql(expr: str) -> str:
    e = rx(expr, '[_"=]' + ALNUM + "+", "_")
    e = rx(e, ALNUM + '+[_"=]', "_")
    return f"CAST(len(regexp_extract_all({e}, {lit(ALNUM + '+')})) AS INTEGER)"


def collapse_sql(expr: str) -> str:
    return rx(expr, " +", " ")


def cleaned_posts_cte(name: str = "cleaned", src: str = "posts", cutoff_year: int = 1997,
                      dedup: bool = True, compat: bool = True) -> str:
    """SQL of ``clean_posts(after_year(posts), squeeze=False)`` as a CTE."""
    staged = f"""
{name}_a AS (
  SELECT *, {clean_text_sql('text')} AS _clean FROM {src}
  WHERE text IS NOT NULL AND (year IS NULL OR year > {cutoff_year})),
{name}_b AS (SELECT *, {strip_sql('_clean')} AS _strip FROM {name}_a),
{name}_c AS (
  SELECT *, {content_tokens_sql('_strip')} AS tokens, {plain_words_sql('_strip')} AS _words
  FROM {name}_b),
{name}_d AS (
  SELECT * EXCLUDE (text, _clean, _strip, _words, _keep),
         CASE WHEN _keep THEN {collapse_sql('_clean')} ELSE 'DELETE' END AS text, _keep
  FROM (SELECT *, tokens > {T.TOKEN_THRESHOLD} AND _words > 0 AS _keep FROM {name}_c)),
{name}_e AS (
  SELECT * EXCLUDE (_keep) FROM {name}_d
  WHERE {"NOT contains(text, 'DELETE')" if compat else "_keep"})"""
    if dedup:
        staged += f""",
{name} AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY post_id) AS _rn FROM {name}_e)
  WHERE _rn = 1)"""
    else:
        staged += f""",
{name} AS (SELECT * FROM {name}_e)"""
    return staged.strip()
