import duckdb
from pyspark.sql import functions as F

from postresp.llm.chat_format import escaped, format_conversations, loss_text, parse_formatted, unescaped

ODD = ["", None, "</s>", "<s>", "</s>\n", "<|+|>", "<|user|>\n", "a<", "|>", "<\\s", "\\", "\\\\<|", "[INST] x [/INST]", "[\\INST]",
       "<<SYS>>", "|\\>", "<|", "<<</s>", "ends with </s", "é漢\U0001F600<|x|>", "line\nline\r\n", "[/INST", "$1 \\$0"]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(x,) for x in ODD + [a + b for a in ODD if a for b in ODD if b]], "text string")
    for r in df.select("text", escaped(F.col("text")).alias("e"), unescaped(escaped(F.col("text"))).alias("u")).collect():
        assert r.u == r.text
        assert not any(c in (r.e or "") for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "|>"))


def turns():
    rows = [(1, i, r, x, "z") for i, (r, x) in enumerate(zip(["user", "user", "assistant", "assistant", "system", None] * 8, ODD))]
    rows += [(2, 5, "assistant", "b", "z"), (2, 5, "assistant", "a", "z"), (2, 5, "assistant", "a", "z"), (2, None, "user", "first", "z")]
    rows += [(3, 0, "a|", "x" * 50000, "z"), (3, 1, "a|>\n", "</s>\n", "z"), (None, 0, "user", None, "z"), (4, 0, "user", "no loss", "z")]
    rows += [(5, i, "assistant" if i % 3 else "user", f"t{i}", "z") for i in range(400)]
    return rows


def test_turns_and_loss_are_read_back(spark):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = format_conversations(df.repartition(7)).withColumn("read", parse_formatted(F.col("formatted")))
    got = {r.conv_id: r for r in out.withColumn("loss", loss_text(F.col("segments"))).collect()}
    assert len(got) == 6
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        assert [(x.role, x.text) for x in r.read] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))
        assert r.formatted.count("</s>\n") == blocks and r.formatted.count("<|+|>") == len(own) - blocks


def test_query_equals_sql(spark):
    from postresp.llm.queries import ORACLE, op6_chat_format
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    res = con.execute(ORACLE["op6_chat_format"])
    names = [d[0] for d in res.description]
    expected = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in res.fetchall())
    df = op6_chat_format(spark, sf)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == expected


def test_sql_counts_odd_texts(spark):
    from postresp.llm.oracles import OP6
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r[:4] for r in turns() if r[2] not in ("a|", "a|>\n")]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    res = con.execute(OP6)
    at = [d[0] for d in res.description].index("formatted_chars")
    expected = {r[0]: r[at] for r in res.fetchall() if r[0] != -7}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: len(r.formatted) for r in format_conversations(df).collect()} == expected


def test_empty_table(spark):
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_spark_expressions_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
