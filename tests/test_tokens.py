import re
import time

import pytest
from pyspark.sql import functions as F

from marginalia.functions import tokens as t

TEXTS = ["", "a", "A small example, with punctuation!", "don't  stop -- now", "é_x 12½ ñ.", "\tleading and trailing \n", "a_b c", "x y z"]


def rows(df, expr):
    return [[tuple(x) for x in r.x] for r in df.orderBy("i").select(expr.alias("x")).collect()]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")


def want(found, text, lower=False):
    return [(x, x.lower() if lower else x, i, at, len(text) - (at + len(x) + 1)) for i, (x, at) in enumerate(found)]


def test_word_punct(df):
    got = rows(df, t.tokenize("s", ignorecase=True))
    for text, g in zip(TEXTS, got):
        assert g == want([(m[0], m.start()) for m in re.finditer(r"\w+|[^\w\s]+", text)], text, True), text
    assert [x[0] for x in rows(df, t.tokenize("s", remove_punctuation=True))[6]] == ["c"]


def test_boundaries(df):
    got = rows(df, t.tokenize("s", boundaries=True))[1]
    assert [(x[0], x[2], x[3]) for x in got] == [("<DOC>", 0, 0), ("a", 1, 0), ("</DOC>", 2, 1)]


def test_split_and_pattern(df):
    got = rows(df, t.tokenize_split("s"))
    for text, g in zip(TEXTS, got):
        pieces = re.split(r"\s+", text)
        keep = [x for i, x in enumerate(pieces) if x or i == len(pieces) - 1]
        assert [x[0] for x in g] == keep and all(text[x[3] : x[3] + len(x[0])] == x[0] for x in g), text
    got = rows(df, t.tokenize_pattern("s", "[a-z]+"))
    for text, g in zip(TEXTS, got):
        assert g == want([(m[0], m.start()) for m in re.finditer("[a-z]+", text)], text)


def test_custom(df):
    got = rows(df, t.custom_tokenizer(str.split)("s"))
    assert [x[0] for x in got[2]] == TEXTS[2].split() and got[5][1][3] == 9


def test_token_functions(df):
    tok = t.tokenize("s")
    one = df.where("i = 2").select(
        t.has_token(tok, "small").alias("a"), t.has_token(tok, "SMALL").alias("b"), F.size(t.get_tokens(tok, ",")).alias("c"), t.token_text(t.lower(tok)).alias("d"), t.rebuild(tok).alias("e")
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e) == (True, False, 1, "a small example , with punctuation !", TEXTS[2])


def test_long_text(spark):
    text = "word, " * 3000
    got = spark.createDataFrame([(text,)], "s string").select(t.tokenize("s").alias("x")).first().x
    assert len(got) == 6000 and all(text[x.char_index : x.char_index + len(x.t)] == x.t for x in got)
    assert spark.createDataFrame([(None,)], "s string").select(F.size(t.tokenize("s"))).first()[0] in (-1, 0, None)


def test_long_text_in_linear_time(spark):
    """The text's length is not counted again for every token: 400,000 tokens took minutes."""
    start = time.time()
    df = spark.range(1).select(F.expr("repeat('ab, ', 200000)").alias("s"))
    last = df.select(F.element_at(t.tokenize("s"), -1).alias("x"), F.size(t.tokenize_split("s")).alias("n")).first()
    assert tuple(last.x) == (",", ",", 399999, 799998, 0) and last.n == 200001
    assert time.time() - start < 40
