"""Golden literals (FIXTURES §4) and plan checks for the cleaning chain."""
import pytest
from pyspark.sql import functions as F

from postresp.functions import text as T

GOLDEN = [
    ('see http://x.co/a more text #navy "q"', 'see  _ _URL"q"', 'see _ ', 1),
    ('go http://x.co #navy', 'go  _ _URL', 'go _ ', 1),
    ('pic.twitter.com/AbC1 now', ' _IMAGE', ' ', 0),
    ('https://pbs.twimg.com/media/Z9.jpg', 'IMAGE', 'IMAGE', 1),
    ('well https://twitter.com/u/status/1 "said"', 'well  _RETWEET"said"', 'well ', 1),
    ('http://twitter.com/u', ' _URL', ' ', 0),
    ('soooo goooood hahahahaha', 'soo good haha', 'soo good haha', 3),
    ('line one\nline two', 'line oneline two', 'line oneline two', 3),
    ('plain _URL', 'plain _URL', 'plain ', 1),
    ('naïve café =z "q" a_b 12', 'naïve café =z "q" a_b 12', 'naïve café =z "q" a_b 12', 3),
    ('!!! ... ---', '!! .. --', '. . -', 0),
]
SQUEEZE = [("aaaa", "aa"), ("a" * 15, "aa"), ("a" * 400, "a" * 8), ("hahahahaha", "haha"),
           ("x aaaa  bbbbbb\tcc", "x aa  bb\tcc")]


def test_golden_clean_strip_words(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "t string")
    out = (df.select(T.clean_text(F.col("t")).alias("c"))
           .select("c", T.strip_low_content(F.col("c")).alias("s"))
           .select("c", "s", T.count_plain_words(F.col("s")).alias("w")).collect())
    for g, r in zip(GOLDEN, out):
        assert (r.c, r.s, r.w) == g[1:], g[0]


@pytest.mark.parametrize("src,expected", SQUEEZE)
def test_squeeze(spark, src, expected):
    df = spark.createDataFrame([(src,)], "t string")
    assert df.select(T.squeeze_repeats(F.col("t"))).first()[0] == expected


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert T.ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_content_tokens_keep_repeats(spark):
    df = spark.createDataFrame([("the cat the cat sat !",)], "t string")
    # tokens: the cat the cat sat ! -> non-stop: cat cat sat ! (filter keeps repeats)
    assert df.select(T.count_content_tokens(F.col("t"))).first()[0] == 4


def test_keep_rule(spark):
    df = spark.createDataFrame([(5, 1), (3, 0), (2, 4), (3, 1)], "n int, w int")
    got = [r[0] for r in df.select(T.keep_post(F.col("n"), F.col("w"))).collect()]
    assert got == [True, False, False, True]


def test_null_text_dropped_and_no_python_udf(spark):
    from postresp.operators.clean import clean_posts
    df = spark.createDataFrame([(1, None), (2, "one two three four five")], "post_id long, text string")
    out = clean_posts(df)
    assert [r.post_id for r in out.collect()] == [2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_keep_filter_not_pushed_below_counts(spark):
    """The regex chain must be evaluated once: the keep filter stays above the Generate."""
    from postresp.operators.clean import clean_posts
    df = spark.createDataFrame([(1, "one two three four")], "post_id long, text string")
    plan = clean_posts(df, dedup=False)._jdf.queryExecution().optimizedPlan().toString()
    gen, filt = plan.find("Generate"), plan.find("Filter")
    assert gen > 0 and 0 <= filt < gen


def test_link_tail_no_stack_overflow(spark):
    long_tail = "http://x.co/" + "a b " * 200000
    df = spark.createDataFrame([(long_tail,)], "t string")
    assert df.select(T.replace_links(F.col("t"))).first()[0] == " _URL"


def test_squeezing_equals_python_on_documents(spark):
    import re
    from pyspark.sql import functions as F
    from postresp.functions import text as T
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = docs.select("text", T.squeeze_repeats(F.col("text")).alias("s")).collect()
    unit = re.compile(r"(\S+)(\1{2,})")
    assert all(r.s == _passes(unit, r.text) for r in got)


ODD_RUNS = ["abcccabccabcc xaaaa", "a\u0001aaa bbbb\u0001 cc", "\u0001", "", " \n", "\nxxx\n\n yyy", "aaa", "aaa\u00a0bbb\u2003ccc", "😀😀😀😀 é😀é😀é😀", "$1$1$1 \\\\\\",
            "ab" * 60 + " " + "xyz" * 41 + "\tq" + "-" * 400, "\x1caaa\x1cbbb", "\x85aaaa\x85", "no repeat here", "…… … --- -- ... .. !!! ! a  b   c"]


def test_squeezing_and_stripping_odd_runs(spark):
    """Runs of a text go through the passes together: as each pass over the whole text gives it."""
    df = spark.createDataFrame([(t,) for t in ODD_RUNS] + [(None,)], "t string")
    whole = F.col("t")
    for _ in range(T.SQUEEZE_PASSES):
        whole = F.regexp_replace(whole, T.SQUEEZE_PATTERN, T.SQUEEZE_REPLACEMENT)
    strip = F.replace("t", F.lit(T.BOILERPLATE_PHRASE), F.lit(""))
    for pat, repl in T.STRIP_RULES:
        strip = F.regexp_replace(strip, pat, repl)
    got = df.select("t", T.squeeze_repeats(F.col("t")).alias("s"), whole.alias("w"), T.strip_low_content(F.col("t")).alias("l"), strip.alias("m")).collect()
    for r in got:
        assert (r.s, r.l) == (r.w, r.m), r.t


def test_a_pass_is_one_call_a_text(spark):
    """The repeated runs of a text are fenced and joined; plain words are searched, not counted."""
    from postresp.operators.clean import clean_posts
    df = spark.createDataFrame([(1, "goooood one two three " * 5000)], "post_id long, text string")
    out = clean_posts(df)
    assert out.first().text == "good one two three " * 5000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "regexp_count" not in plan


def _passes(unit, x):
    for _ in range(10):
        x = unit.sub(lambda m: m.group(2), x)
    return x


def test_cleaning_is_stable_under_repartitioning(spark):
    from postresp.operators.clean import clean_posts
    from postresp.sources.posts import posts
    p = posts(spark, "/root/testdata/sf0.001")
    a, b = clean_posts(p.repartition(3)), clean_posts(p.repartition(11, "text"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_rules_are_applied_where_their_matches_can_be(spark):
    """What a rule's matches hold is looked for first; the texts come out as from the plain chain."""
    texts = ["", "none of it", "pic twitter.com/a pic.twitter.com/b c", "http:/ https:// http://x https://pbs.twimg.com/media/q.jpg", "https://twitter.com/u/1 x",
             "URL# URL#a b", "picxtwitterxcom/é", "a@b @ @c", "_IMAGEx _URL _RETWEET1 ht", "a\u00a0b - -- --- . .. ! !!", "  x  ", "…", "_URL…", "é  漢", None]
    df = spark.createDataFrame([(t,) for t in [*texts, "  ".join(t for t in texts if t)]], "t string")
    links, strip = F.col("t"), F.replace("t", F.lit(T.BOILERPLATE_PHRASE), F.lit(""))
    for prefix, repl in T.LINK_RULES:
        links = F.regexp_replace(links, prefix + T.LINK_TAIL_COMPAT, repl)
    for pat, repl in T.STRIP_RULES:
        strip = F.regexp_replace(strip, pat, repl)
    got = df.select("t", T.replace_links(F.col("t")).alias("l"), links.alias("m"), T.strip_low_content(F.col("t")).alias("s"), strip.alias("u"),
                    T.collapse_spaces(F.col("t")).alias("c"), F.regexp_replace("t", " +", " ").alias("d"))
    for r in got.collect():
        assert (r.l, r.s, r.c) == (r.m, r.u, r.d), r.t
    plan = got.select("l", "s", "c")._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("contains(") >= len(T.LINK_RULES) + len(T.STRIP_RULES)


def test_a_pass_that_changes_nothing_is_the_last(spark):
    """Repeats of every length of unit and number of copies, in short and long runs, as ten passes leave them."""
    import re
    unit = re.compile(r"(\S+)(\1{2,})")
    texts = ["q" * a + "abcdefghijkl"[:u] * n + "z" * b for u in (1, 2, 3, 4, 5, 11) for n in (2, 3, 4, 9, 40) for a, b in ((0, 0), (1, 2), (7, 0))]
    texts.append(" ".join(texts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.squeeze_repeats(F.col("t")).alias("s"))
    assert all(r.s == _passes(unit, r.t) for r in got.collect())
    assert re.search(r"CASE WHEN \(lambda \S+ = lambda", got._jdf.queryExecution().analyzed().toString())
