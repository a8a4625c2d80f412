"""Tokenizers as column expressions: arrays of structs {t, n, i, char_index, char_end_index}.

t is the token, n its normalised form, i its place, char_index its offset in code points and char_end_index the distance to the
text's end less one, as the token model counts it. A pattern that tiles the text gives pieces whose lengths add up to offsets,
so nothing is searched twice; Python only sums them. Null texts give null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ColumnOrName, _col

TOKEN = T.ArrayType(
    T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("char_index", T.IntegerType()), T.StructField("char_end_index", T.IntegerType())])
)
TYPE = TOKEN.simpleString()
#: Words, runs of other visible characters, and white space: together they tile any text.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+"


PIECES = "array<struct<s:string,at:int,size:int>>"


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])))
def running_sums(sizes: pa.Array) -> pa.Array:
    """The sum of the numbers ahead of each, and of all of its list."""
    starts = sizes.offsets.to_numpy()
    own = starts - starts[0]
    total = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.int64))])
    at = total[:-1] - np.repeat(total[own[:-1]], np.diff(own))
    size = np.repeat(np.diff(total[own]), np.diff(own))
    out = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(size, pa.int32())], names=["at", "size"])
    return pa.ListArray.from_arrays(pa.array(own, pa.int32()), out, mask=sizes.is_null() if sizes.null_count else None)


def pieces(c: Column, tiling: str) -> Column:
    """array<struct<s,at,size>>: the tiling pattern's matches with their offsets and the text's size.

    Offsets are summed in Arrow batches of whole columns. The size is a field, as a text's length in a lambda is counted again for every token.
    """
    found = F.regexp_extract_all(c, F.lit(f"(?sU){tiling}"), F.lit(0))
    return F.zip_with(found, running_sums(F.transform(found, F.length)), lambda s, x: F.struct(s.alias("s"), x["at"].alias("at"), x["size"].alias("size")))


def _tokens(c: Column, spans: Column, ignorecase: bool, boundaries: bool) -> Column:
    size, first = F.length(c), 1 if boundaries else 0  # once a text

    def token(x: Column, i: Column) -> Column:
        norm = F.lower(x["s"]) if ignorecase else x["s"]
        return F.struct(x["s"].alias("t"), norm.alias("n"), (i + first).cast("int").alias("i"), x["at"].cast("int").alias("char_index"), (x["size"] - (x["at"] + F.length(x["s"]) + 1)).cast("int").alias("char_end_index"))

    out = F.transform(spans, token)
    if boundaries:
        edge = lambda s, i, at: F.array(F.struct(F.lit(s).alias("t"), F.lit(s).alias("n"), i.cast("int").alias("i"), at.cast("int").alias("char_index"), (size - at).cast("int").alias("char_end_index")))
        out = F.concat(edge("<DOC>", F.lit(0), F.lit(0)), out, edge("</DOC>", F.size(spans) + 1, size))
    return out


def tokenize(c: ColumnOrName, ignorecase: bool = False, remove_punctuation: bool = False, boundaries: bool = False) -> Column:
    """Words and runs of punctuation with offsets. remove_punctuation keeps purely alphanumeric tokens, so a_b goes too."""
    c = _col(c)
    spans = F.filter(pieces(c, WORD_PUNCT), lambda x: ~x["s"].rlike(r"(?U)^\s"))
    if remove_punctuation:
        spans = F.filter(spans, lambda x: x["s"].rlike(r"^[\p{L}\p{N}]+$"))
    return _tokens(c, spans, ignorecase, boundaries)


def tokenize_split(c: ColumnOrName, separator: str = r"\s", ignorecase: bool = False, boundaries: bool = False) -> Column:
    """Tokens between runs of a separator, a character class; empty pieces go, but the one after a closing separator stays."""
    c = _col(c)
    inner = separator[1:-1] if separator.startswith("[") else separator
    tiles = pieces(c, f"[{inner}]+|[^{inner}]+")
    spans = F.filter(tiles, lambda x: ~x["s"].rlike(f"(?U)^[{inner}]"))
    closing = F.when((F.length(c) == 0) | c.rlike(f"(?U)[{inner}]\\z"), F.array(F.struct(F.lit("").alias("s"), F.length(c).cast("int").alias("at"), F.length(c).cast("int").alias("size"))))
    return _tokens(c, F.concat(spans, F.coalesce(closing, F.array().cast(PIECES))), ignorecase, boundaries)


def tokenize_pattern(c: ColumnOrName, token: str, ignorecase: bool = False, boundaries: bool = False) -> Column:
    """Tokens that match a pattern without lookaround; what lies between is skipped."""
    c = _col(c)
    tiles = pieces(c, f"(?:{token})|.")
    return _tokens(c, F.filter(tiles, lambda x: x["s"].rlike(f"(?sU)^(?:{token})\\z")), ignorecase, boundaries)


def custom_tokenizer(func: Callable[[str], list[str]], ignorecase: bool = False) -> Callable[[ColumnOrName], Column]:
    """A tokenizer from a Python function text -> strings, which are located from left to right. Runs in Arrow batches."""

    @F.pandas_udf(TOKEN)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows, at = [], 0
            for i, s in enumerate(func(text) if text is not None else []):
                at = text.index(s, at)
                rows.append({"t": s, "n": s.lower() if ignorecase else s, "i": i, "char_index": at, "char_end_index": len(text) - (at + len(s) + 1)})
                at += len(s)
            out.append(rows if text is not None else None)
        return pd.Series(out)

    return run


def normalised(tokens: ColumnOrName) -> Column:
    return F.transform(_col(tokens), lambda t: t["n"])


def update(tokens: ColumnOrName, f: Callable[[Column], Column]) -> Column:
    """Tokens with another normalised form, a function of the present one."""
    return F.transform(_col(tokens), lambda t: t.withField("n", f(t["n"])))


def lower(tokens: ColumnOrName) -> Column:
    return update(tokens, F.lower)


def has_token(tokens: ColumnOrName, s: str) -> Column:
    """Whether a token has the string as its original or normalised form."""
    return F.exists(_col(tokens), lambda t: (t["t"] == s) | (t["n"] == s))


def get_tokens(tokens: ColumnOrName, s: str) -> Column:
    """Tokens whose original form is the string; without any, those whose normalised form is."""
    own = F.filter(_col(tokens), lambda t: t["t"] == s)
    return F.when(F.size(own) > 0, own).otherwise(F.filter(_col(tokens), lambda t: t["n"] == s))


def token_text(tokens: ColumnOrName) -> Column:
    """Normalised tokens joined by spaces."""
    return F.array_join(normalised(tokens), " ")


def rebuild(tokens: ColumnOrName) -> Column:
    """The text of tokens at their offsets, gaps filled with spaces."""
    return F.aggregate(_col(tokens), F.lit(""), lambda acc, t: F.concat(acc, F.repeat(F.lit(" "), F.greatest(t["char_index"] - F.length(acc), F.lit(0))), t["t"]))
