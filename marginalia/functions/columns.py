"""The same string functions as Spark column expressions; everything stays in the JVM.

Positions are code points, as in Spark's own substring and length. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import AFFIXES_1, AFFIXES_2, PUNCTUATION, skip_offsets

ColumnOrName = Column | str
WORD = "[\\p{L}\\p{N}_]"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a lambda would compute a captured expression anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(c: ColumnOrName) -> Column:
    """A string as an array of its characters."""
    c = _col(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def ngrams(c: ColumnOrName, n: int) -> Column:
    """Character n-grams of the string padded by one # on each side; empty if it is shorter than n."""
    if n <= 0:
        raise ValueError("n must be positive")
    c = _col(c)
    padded = F.concat(F.lit("#"), c, F.lit("#"))
    size = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), size + 3 - n), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(size < n, F.array().cast("array<string>")).otherwise(grams)


def skipgrams(c: ColumnOrName, n: int = 2, skip: int = 2) -> Column:
    """array<struct<sg,start,end_offset,len>> of a string's skipgrams, as scalar.skipgrams gives them."""
    if n <= 0 or skip < 0:
        raise ValueError("n must be positive and skip zero or more")
    c = _col(c)
    size = F.length(c)

    def gram(s: Column, start: Column, end: Column, length: Column) -> Column:
        return F.struct(s.alias("sg"), start.cast("int").alias("start"), end.cast("int").alias("end_offset"), length.cast("int").alias("len"))

    if n == 1:
        return F.transform(chars(c), lambda x, i: gram(x, F.lit(0), size - i + 1, F.lit(1)))

    def many(a: Column) -> Column:
        def at(i: Column) -> Column:
            picks = [
                F.when(i + p[-1] < F.size(a), gram(F.concat(F.get(a, i), *[F.get(a, i + x) for x in p]), i, F.size(a) - i + 1, F.lit(p[-1] + 1)))
                for p in skip_offsets(n, skip)
            ]
            return F.filter(F.array(*picks), lambda x: x.isNotNull())

        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 2, F.lit(0))), at))

    return F.when(size <= n, F.array(gram(c, F.lit(0), F.lit(0), size))).otherwise(let(chars(c), many))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))

    def body(p: Column) -> Column:
        return F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda acc, x: acc + F.least(count(p["a"], x), count(p["b"], x)))

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def char_overlap(a: ColumnOrName, b: ColumnOrName) -> Column:
    return multiset_overlap(chars(a), chars(b))


def char_overlap_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.when(F.length(_col(a)) > 0, char_overlap(a, b) / F.length(_col(a)))


def ngram_overlap(a: ColumnOrName, b: ColumnOrName, n: int) -> Column:
    return multiset_overlap(ngrams(a, n), ngrams(b, n))


def ngram_overlap_ratio(a: ColumnOrName, b: ColumnOrName, n: int) -> Column:
    size = F.size(ngrams(a, n))
    return F.when(size > 0, ngram_overlap(a, b, n) / size)


def lcs(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""

    def table(y: Column) -> Column:
        def row(prev: Column, c: Column) -> Column:
            def step(acc: Column, j: Column) -> Column:
                best = F.when(F.get(y, j) == c, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(acc, -1)))
                return F.concat(acc, F.array(best))

            return F.when(F.size(y) == 0, prev).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(y) - 1, F.lit(0))), F.array(F.lit(0)), step))

        return F.element_at(F.aggregate(chars(a), F.array_repeat(F.lit(0), F.size(y) + 1), row), -1)

    return let(chars(b), table)


def indel_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """2 * lcs / (length + length), 1 for two empty strings. For short strings; searches use scalar.indel_ratio."""
    total = F.length(_col(a)) + F.length(_col(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * lcs(a, b) / total)


def levenshtein(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.levenshtein(_col(a), _col(b))


def non_word_prefix(c: ColumnOrName) -> Column:
    two, one = F.substring(_col(c), 1, 2), F.substring(_col(c), 1, 1)
    return F.when(two.isin(*sorted(AFFIXES_2)), two).when(one.isin(*sorted(AFFIXES_1)), one).otherwise(F.lit(""))


def non_word_suffix(c: ColumnOrName) -> Column:
    two, one = F.right(_col(c), F.lit(2)), F.right(_col(c), F.lit(1))
    return F.when(two.isin(*sorted(AFFIXES_2)), two).when(one.isin(*sorted(AFFIXES_1)), one).otherwise(F.lit(""))


def strip_prefix(c: ColumnOrName) -> Column:
    c = _col(c)
    at = lambda i: F.substring(c, i, 1)
    from_ = lambda i: F.substring(c, F.lit(i), F.length(c))
    two = F.substring(c, 1, 2).isin(*sorted(AFFIXES_2)) | at(2).isin(" ", ",")
    return F.when(F.length(c) <= 2, c).when(two, from_(3)).when(at(1).isin(" ", ","), from_(2)).otherwise(c)


def strip_suffix(c: ColumnOrName) -> Column:
    c = _col(c)
    size = F.length(c)
    at = lambda back: F.substring(c, size - (back - 1), F.lit(1))
    cut = lambda k: F.substring(c, F.lit(1), size - k)
    two = at(2).isin(" ", ",") | F.right(c, F.lit(2)).isin(", ", ". ", "! ", "? ")
    return F.when(size <= 2, c).when(two, cut(2)).when(at(1).isin(" ", ","), cut(1)).otherwise(c)


def map_string(c: ColumnOrName, punctuation: str = PUNCTUATION, whitespace_only: bool = False) -> Column:
    """s for white space, and for punctuation unless told otherwise; w for the rest."""
    seps = " \t\n\r" + ("" if whitespace_only else punctuation)
    cls = "".join("\\" + x if x in "\\[]^-&" else x for x in seps)
    marked = F.regexp_replace(_col(c), f"[^{cls}]", "\u0001")
    return F.translate(F.regexp_replace(marked, f"[{cls}]", "s"), "\u0001", "w")


def begin_similarity(a: ColumnOrName, b: ColumnOrName, n: int) -> Column:
    k = F.least(F.lit(n), F.length(_col(a)), F.length(_col(b)))
    cut = lambda c: F.substring(_col(c), F.lit(1), k)
    return F.when(k > 0, 1 - F.levenshtein(cut(a), cut(b)) / k).otherwise(F.lit(0.0))


def end_similarity(a: ColumnOrName, b: ColumnOrName, n: int) -> Column:
    k = F.least(F.lit(n), F.length(_col(a)), F.length(_col(b)))
    return F.when(k > 0, 1 - F.levenshtein(F.right(_col(a), k), F.right(_col(b), k)) / k).otherwise(F.lit(0.0))


def close_distance(a: ColumnOrName, b: ColumnOrName, most: int, ratio: float) -> Column:
    a, b = _col(a), _col(b)
    d = F.levenshtein(a, b)
    return (F.abs(F.length(a) - F.length(b)) <= most) & (d < most) & ((d / F.length(a) < ratio) | (d / F.length(b) < ratio))


def is_distractor(text_token: ColumnOrName, phrase_token: ColumnOrName, most: int = 2) -> Column:
    a, b = _col(text_token), _col(phrase_token)
    d, gap = F.levenshtein(a, b), F.abs(F.length(a) - F.length(b))
    return F.when((F.length(a) <= 3) & (d == gap), ~F.contains(b, a)).otherwise(d - gap > most)


def escape(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"([\\.^$*+?{}\[\]|()])", r"\\$1")


def vector_length(freq: Column) -> Column:
    """Euclidean norm of an array of frequencies."""
    return F.sqrt(F.aggregate(freq, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def register(spark) -> None:
    """The functions as temporary SQL functions (SQL bodies, no Python at run time where Spark can express them)."""
    from . import scalar

    spark.udf.register("indel_ratio", _vector(scalar.indel_ratio))
    spark.udf.register("char_overlap_ratio", _vector(scalar.char_overlap_ratio))
    spark.udf.register("ngram_overlap_ratio", _vector(scalar.ngram_overlap_ratio))


def _vector(f):
    """A scalar function as an Arrow-batched UDF that computes each distinct row of arguments once a batch."""
    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def run(*cols: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for row in zip(*cols):
            if row not in memo:
                memo[row] = None if any(x is None for x in row) else f(*row)
            out.append(memo[row])
        return pd.Series(out, dtype="float64")

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return pandas_udf(two if f.__code__.co_argcount == 2 else three, "double", PandasUDFType.SCALAR)
