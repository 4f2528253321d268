from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as TX


def one(spark, col, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_lower_ascii_hand_case(spark):
    assert one(spark, TX.lower_ascii("t"), [("Naïve BAYES – É",)]) == ["nave bayes  "]


def test_keyword_summary(spark):
    rows = [([" a ", "", "a", "  "],), ([],)]
    got = one(spark, TX.keyword_summary("k"), rows, "k array<string>")
    assert got == [" , a", ""]


def test_period_split_tokens(spark):
    toks = ["fig.2", "10.5", "3.50", "e.g.", ".net", "..."]
    got = one(spark, TX.split_periods(F.col("k")), [(toks,)], "k array<string>")[0]
    assert got == ["fig . 2", "10 . 5", "3.50", "e.g.", " . net", "..."]


def test_dash_leaves_two_blanks(spark):
    assert one(spark, TX.core_tokenize("t"), [("a – b",)]) == ["a  b"]


def test_core_tokenize_examples(spark):
    rows = [('He said "I can\'t pay $3.50, it\'s in Fig.2 (see e.g. foo.bar) --- A/B.',),
            ('the end. Next one... 10.5 U.S. a_b "cannot".',)]
    assert one(spark, TX.core_tokenize("t"), rows) == [
        "he said `` i ca n't pay $ 3.50 , it 's in fig . 2 ( see e.g. foo . bar ) -- - a / b .",
        "the end . next one ... 10 . 5 u.s. a _ b `` can not '' ."]


def test_regex_period_rule_equals_array_form(spark):
    rows = [("x .net ab.cd.ef fig. e.g. ... ..ab a.bc 3.50 end.",), ("",), ("a b  c",)]
    fast = one(spark, TX.core_tokenize("t"), rows)
    slow = one(spark, TX.lower_ascii(TX.join_collapse(TX.split_periods(TX.treebank_tokens("t")))),
               rows)
    assert fast == slow


def test_concat_text_hand_case(spark):
    got = spark.createDataFrame([("k", "", "a")], "k string, t string, a string") \
        .select(TX.concat_text("k", "t", "a")).first()[0]
    assert got == "k  a"


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_lower_ascii_is_ascii_and_idempotent(spark, s):
    a, b = spark.createDataFrame([(s,)], "t string").select(
        TX.lower_ascii("t").alias("a"), TX.lower_ascii(TX.lower_ascii("t")).alias("b")).first()
    assert all(ord(c) < 128 for c in a)
    assert a == b


def test_fast_rules_give_the_tokens_of_the_rule_list(spark):
    import random
    draw = random.Random(12)
    parts = ["cannot", "Cannot", "gonna", "WANNA", "gotta", "lemme", "gimme", "'tis", "'Twas", "can", "not", "a", "'s", "n't", "N'T", "'ll", "'",
             "''", '"', " ", " ", " ", "  ", "\t", "\u00a0", ".", "..", ",", "-", "é", "_", "don't", "x's", "it'll", "(", "]", "?", "n", "t", "was"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    slow = F.filter(F.split(TX._apply_rules(F.col("text"), TX.TOKEN_RULES), "[" + TX.WS + "]+", -1), lambda t: F.length(t) > 0)
    wrong = df.select("text", slow.alias("a"), TX.treebank_tokens("text").alias("b"), TX.core_tokenize("text").alias("c"),
                      TX.lower_ascii(TX.join_collapse(TX.split_periods(slow))).alias("d")).where("a <> b or c <> d")
    assert wrong.collect() == []


def test_plain_replacements_and_shared_passes(spark):
    assert len(TX.FAST_RULES) < len([r for r in TX.TOKEN_RULES if r[0] != "TWICE"]) + 2
    assert [r[0] for r in TX.FAST_RULES].count("PLAIN") == 2
    rows = [('a --b"c" ;x?!  d\x1ce',), ("  .net  fig. ",), ("　",)]
    assert one(spark, TX.core_tokenize("t"), rows) == ["a -- b '' c '' ; x ? ! d e", " . net fig .", ""]
    slow = one(spark, TX.lower_ascii(TX.join_collapse(TX.split_periods(TX.treebank_tokens("t")))), rows)
    assert slow == one(spark, TX.core_tokenize("t"), rows)
