"""Quality rules: base counts and a distribution-divergence verdict.

A document's character-class histogram and its histogram of common words are compared with those of its language by
Jensen-Shannon distance (base 2, so 0 to 1). The language references are the whole corpus's: every document of the language
adds its histograms, each document's normalised first, so that a long document weighs no more than another; a reference is
then trimmed step by step: documents further from the last reference than the next of `trim` don't count for the next. A document is rejected
if its character distance exceeds `char_limit` plus `slack` over the root of its length, or its word distance `word_limit`; the
distances count only from `min_chars`
characters and `min_words` words on, as short texts stray by chance. Languages of fewer than `min_docs` documents have no
reference, and their documents pass.

Histograms are computed in one pass over the texts and written to the shared folder; references are aggregates with as many
rows as there are languages, so a hot language costs one partial sum a task.

Words are runs without ASCII white space. Nulls: a null text has no words (and fails the base rule); a null language is one of
its own. Empty tables give empty results, repeated rows repeated ones; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_str, stored, table

#: Character classes and their characters; what is left over, letters of any script without ASCII capitals, is the last class.
#: Letters aren't told apart, as documents of two languages are fine.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r\x0b\x0c", ".,", ";:!?'\"()-", "#*$%&|<>", "/\\_=+@[]{}~^`")
SYMBOLS = 6
#: Common words of several languages; a word's count goes to its place, every other word to the last one.
COMMON = ("the and of to in is it that for was on are as with by at be this have from or an not which a "
          "der die das und ist von zu mit für auf den im ein eine nicht dem des sich "
          "la le les et de des une du en que pour dans qui est pas sur "
          "el los las y del un por con para una su se no al lo").split()  # fmt: skip
N_CHAR, N_WORD = len(CLASSES) + 1, len(dict.fromkeys(COMMON)) + 1
SPACE = " \t\n\x0b\x0c\r"
LIMITS = {"char_limit": 0.19, "slack": 0.6, "word_limit": 0.7, "min_chars": 400, "min_words": 100, "trim": (0.3, 0.2, 0.12), "min_docs": 50}
_PLACE = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON))}
_STRIP = b".,;:!?\"'()"

FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, p_chars array<double>, p_words array<double>"


def repeat_words(codes: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more; codes: the text's words as small integers."""
    n = len(codes) - 2
    if n < 2:
        return 0
    width = int(codes.max()) + 1
    if width < 1 << 21:
        keys = (codes[:-2] * width + codes[1:-1]) * width + codes[2:]
    else:  # exact for any vocabulary: pairs first
        pair = pd.factorize(codes[:-1].astype(object) * width + codes[1:])[0].astype(np.int64)
        keys = pair[:-1] * (n + 2) + pair[1:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and both histograms of a whole text."""
    count = text.count
    chars = [sum(map(count, c)) for c in CLASSES]
    chars.append(len(text) - sum(chars))
    raw = text.encode()
    words = raw.split()  # bytes: ASCII white space only
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    hist = [0] * N_WORD
    if words:
        n = np.bincount(codes)
        for w, i in index.items():
            hist[_PLACE.get(w.strip(_STRIP).lower(), N_WORD - 1)] += int(n[i])
    return len(words), len(text) - sum(map(count, SPACE)), chars[SYMBOLS], dup, repeat_words(codes), chars, hist


def _shares(hist: list[list[int]]) -> pa.Array:
    """Histograms as shares; all zero where one is empty."""
    x = np.array(hist, np.float64)
    x /= np.maximum(1.0, x.sum(1, keepdims=True))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """measure() of every document, histograms as shares (see FEATURES). No shuffle."""

    def run(it):
        for b in it:
            if b.num_rows:
                texts = as_str(b, "t")
                rows = list(zip(*map(measure, texts)))
                counts = [pa.array(c, pa.int64()) for c in (*rows[:5], map(len, texts))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, _shares(rows[5]), _shares(rows[6])], names=[x.split()[0] for x in FEATURES.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).mapInArrow(run, FEATURES)


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two columns of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _reference(shares: DataFrame) -> DataFrame:
    """Mean shares per language: _lang, ref_chars, ref_words, docs."""
    cols = [F.avg(F.col("p_chars")[i]).alias(f"c{i}") for i in range(N_CHAR)] + [F.avg(F.col("p_words")[i]).alias(f"w{i}") for i in range(N_WORD)]
    sums = shares.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("docs"), *cols)
    return sums.select("_lang", "docs", F.array(*[f"c{i}" for i in range(N_CHAR)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(N_WORD)]).alias("ref_words"))


def references(measured: DataFrame, limits: dict | None = None) -> DataFrame:
    """Language references from features() of a corpus: _lang, docs, ref_chars, ref_words."""
    lim = LIMITS | (limits or {})
    shares = measured.where((F.col("n_words") >= lim["min_words"]) & (F.col("n_chars") >= lim["min_chars"]))
    ref = stored(_reference(shares))
    for most in lim["trim"]:
        near = shares.join(ref, F.col("lang").eqNullSafe(F.col("_lang"))).where(_distance("p_chars", "ref_chars") <= most)
        ref = stored(_reference(near.select("lang", "p_chars", "p_words")))
    return ref


def judge(measured: DataFrame, refs: DataFrame, limits: dict | None = None) -> DataFrame:
    """Verdicts: features' counts, base_failed, kept, char_distance, word_distance (null without a reference)."""
    lim = LIMITS | (limits or {})
    refs = refs.where(F.col("docs") >= lim["min_docs"])
    both = measured.join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    has = F.col("ref_chars").isNotNull()
    d = both.select(
        "*",
        F.when(has & (F.col("n_chars") >= lim["min_chars"]), F.round(_distance("p_chars", "ref_chars"), 6)).alias("char_distance"),
        F.when(has & (F.col("n_words") >= lim["min_words"]), F.round(_distance("p_words", "ref_words"), 6)).alias("word_distance"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    most = lim["char_limit"] + lim["slack"] / F.sqrt(F.greatest(F.lit(1), F.col("n_chars")))
    ok = (F.coalesce("char_distance", F.lit(0.0)) <= most) & (F.coalesce("word_distance", F.lit(0.0)) <= lim["word_limit"])
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ok).alias("kept"), "char_distance", "word_distance")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: dict | None = None) -> DataFrame:
    """A row per document: counts, base_failed, kept and both distances, against references from these documents."""
    measured = stored(features(docs, id_col, text_col, lang_col))
    return judge(measured, references(measured, limits), limits)


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assess() of all documents: a row each, repeated rows too. Null and empty texts fail the base rule; an empty table gives no rows."""
    return assess(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The whole query for DuckDB, by plain list operations."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    cls = lambda c: q("[" + "".join("\\" + x if x in "\\[]^-" else x for x in c) + "]")
    upper, common, lim = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", list(dict.fromkeys(COMMON)), LIMITS
    n_of = [f"(length(t) - length(regexp_replace(t, {cls(c)}, '', 'g')))" for c in CLASSES]
    js = lambda p, r: (
        f"round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: "
        f"CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {r}[i]) / 2)) ELSE 0.0 END + CASE WHEN {r}[i] > 0 THEN {r}[i] * log2({r}[i] / (({p}[i] + {r}[i]) / 2)) ELSE 0.0 END)) / 2)), 6)"
    )
    mean = lambda p, n: "[" + ", ".join(f"avg(p.{p}[{i}])" for i in range(1, n + 1)) + "]"
    trims = "\n".join(
        f"ref{i + 1} AS (SELECT p.lang, count(*) AS docs, {mean('pc', N_CHAR)} AS rc, {mean('pw', N_WORD)} AS rw FROM long p JOIN ref{i} r ON p.lang IS NOT DISTINCT FROM r.lang WHERE {js('pc', 'r.rc')} <= {most} GROUP BY p.lang),"
        for i, most in enumerate(lim["trim"])
    )
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, [{", ".join(n_of)}] AS part,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
h AS (SELECT w.*, length(t) AS n_all, coalesce(n_repeat_words, 0) AS n_repeat_words, list_append(part, length(t) - list_sum(part)) AS chars,
  list_transform(ws, lambda x: coalesce(list_position([{", ".join(map(q, common))}], translate(trim(x, {q(_STRIP.decode())}), {q(upper)}, {q(upper.lower())})), 0)) AS places
  FROM w LEFT JOIN cov USING (doc_id)),
p AS (SELECT *, list_transform(chars, lambda x: CASE WHEN n_all > 0 THEN x / n_all ELSE 0.0 END) AS pc,
  list_transform(list_append(range(1, {N_WORD}), 0), lambda k: CASE WHEN len(ws) > 0 THEN len(list_filter(places, lambda x: x = k)) / len(ws) ELSE 0.0 END) AS pw FROM h),
long AS (SELECT * FROM p WHERE len(ws) >= {lim["min_words"]} AND n_all >= {lim["min_chars"]}),
ref0 AS (SELECT lang, count(*) AS docs, {mean("pc", N_CHAR)} AS rc, {mean("pw", N_WORD)} AS rw FROM long p GROUP BY lang),
{trims}
j AS (SELECT p.*, CASE WHEN docs >= {lim["min_docs"]} AND n_all >= {lim["min_chars"]} THEN {js("pc", "ref.rc")} END AS char_distance,
  CASE WHEN docs >= {lim["min_docs"]} AND len(ws) >= {lim["min_words"]} THEN {js("pw", "ref.rw")} END AS word_distance,
  len(ws) < 50 OR 100 * n_repeat_words > 50 * len(ws) AS base_failed FROM p LEFT JOIN ref{len(lim["trim"])} ref ON p.lang IS NOT DISTINCT FROM ref.lang)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, part[{SYMBOLS + 1}]::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0.0) <= {lim["char_limit"]} + {lim["slack"]} / sqrt(greatest(1, n_all)) AND coalesce(word_distance, 0.0) <= {lim["word_limit"]} AS kept,
  char_distance, word_distance
FROM j"""


QUERIES = {"op6_divergence_rules": op6_divergence_rules}
SQL = {"op6_divergence_rules": _sql()}
