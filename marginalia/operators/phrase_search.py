"""Phrase search over a DataFrame of documents: one narrow stage, the model in the task's closure.

Every search returns the columns of MATCH_SCHEMA, a row per match. Null texts have no matches; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.matching import Match, Searcher, is_word
from marginalia.plans.config import SearchConfig, phrase_config
from marginalia.plans.model import MODEL_LIMIT, WORDS, PhraseModel
from marginalia.sources.shared import stored

MATCH_FIELDS = (
    "phrase string, variant string, string string, offset int, end int, labels array<string>, char_match double, "
    "ngram_match double, skipgram_overlap double, levenshtein_similarity double, is_exact boolean"
)
ARROW = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
#: Rows of a result batch, whatever a document's number of matches.
ROWS = 20_000


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where a small table comes in fewer partitions than that; larger ones stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.isStreaming or docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores)


def map_texts(docs: DataFrame, id_col: str, text_col: str, make, fields: str, types: list[pa.DataType]) -> DataFrame:
    """make() gives a function text -> tuples, once a task; their rows behind the document's id. Narrow."""
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for b in it:
            ids, rows = [], []

            def batch() -> pa.RecordBatch:
                cols = zip(*rows)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    got = find(text)
                    rows += got
                    ids += [i] * len(got)
                    if len(rows) >= ROWS:
                        yield batch()
                        ids, rows = [], []
            if rows:
                yield batch()

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, {fields}")


def search_phrases(docs: DataFrame, model: PhraseModel, config: dict | SearchConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fuzzy and exact matches of a model's phrases."""
    settings = phrase_config(config)

    def make():
        searcher = Searcher(model, settings)
        return searcher.search

    return map_texts(docs, id_col, text_col, make, MATCH_FIELDS, ARROW).withColumn("ignorecase", F.lit(settings.ignorecase))


class ExactMatcher:
    """All phrases of a model in one automaton, so a text is read once however many there are."""

    def __init__(self, model: PhraseModel, config: SearchConfig):
        self.config = config
        self.fold = str.lower if config.ignorecase else str
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple]] = {}
        for main, p in model.entries(config.include_variants):
            word = WORDS.search(p.text)
            by_text.setdefault(self.fold(p.text), []).append((main, p.text, model.phrases[main].labels, *(word.span() if word else (-1, -1))))
        for text, entries in by_text.items():
            self.automaton.add_word(text, entries)
        if by_text:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """Rows of MATCH_FIELDS."""
        low, out, done = self.fold(text), [], {}
        if len(low) != len(text):  # a character whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for last, entries in self.automaton.iter(low) if len(self.automaton) else ():
            for main, phrase, labels, a, z in entries:
                at, end = last + 1 - len(phrase), last + 1
                if self.config.use_word_boundaries:
                    # The first word of the phrase must be a whole word of the text, and the text's last character isn't looked at.
                    if a < 0 or (at + a > 0 and is_word(text[at + a - 1])) or (at + z < len(text) and is_word(text[at + z])):
                        continue
                    if (at > 0 and is_word(text[at - 1])) or (end < len(text) - 1 and is_word(text[end])):
                        continue
                elif done.get(phrase, 0) > at:  # occurrences of a phrase don't overlap each other
                    continue
                done[phrase] = end
                out.append((main, phrase, text[at:end], at, end, labels, 1.0, 1.0, 1.0, 1.0, True))
        return out


def exact_matches(docs: DataFrame, model: PhraseModel, config: dict | SearchConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact matches alone, by one automaton over each text; ignorecase compares lower-cased characters.

    Without word boundaries occurrences of a phrase don't overlap each other. Empty models and null texts have no matches.
    """
    c = phrase_config(config)
    return map_texts(docs, id_col, text_col, lambda: ExactMatcher(model, c).find, MATCH_FIELDS, ARROW).withColumn("ignorecase", F.lit(c.ignorecase))


def search_slices(docs: DataFrame, phrases: DataFrame, search: Callable[[DataFrame, PhraseModel], DataFrame], phrase_col: str = "phrase", most: int = MODEL_LIMIT) -> DataFrame:
    """search(docs, model) over a table of phrases of any size: in slices of about half of `most`, each searched and written before the next is read.

    Phrases are taken once each; null and empty ones have no matches. The driver holds one slice at a time.
    """
    own = phrases.select(F.col(phrase_col).alias("_p")).where("_p is not null and _p <> ''").distinct()
    n = own.count()
    if n <= most:
        return search(docs, PhraseModel([r["_p"] for r in own.collect()]))
    parts = -(-2 * n // most)
    found = [stored(search(docs, PhraseModel([r["_p"] for r in own.where(F.pmod(F.xxhash64("_p"), F.lit(parts)) == k).collect()]))) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


# --- set operations on tables of matches ---


def passing(matches: DataFrame, config: dict | SearchConfig | None = None) -> DataFrame:
    c = phrase_config(config)
    return matches.where((F.col("char_match") >= c.char_match_threshold) & (F.col("ngram_match") >= c.ngram_threshold) & (F.col("levenshtein_similarity") >= c.levenshtein_threshold))


def combine(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Exact matches, and fuzzy ones where no exact match of the phrase has the same document and offset."""
    keys = [exact[k].eqNullSafe(fuzzy[k]) for k in ("doc_id", "offset", "phrase")]
    return exact.unionByName(fuzzy.join(exact, keys[0] & keys[1] & keys[2], "left_anti"))


def best_of_same_span(matches: DataFrame, first_best: bool = False) -> DataFrame:
    """Of matches with the same document, offset and length those of highest similarity, or the first of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "offset", F.length("string"))
    order = F.col("levenshtein_similarity").desc()
    rank = F.row_number().over(w.orderBy(order, "phrase", "variant")) if first_best else F.rank().over(w.orderBy(order))
    return matches.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def within_offset(matches: DataFrame, model: PhraseModel) -> DataFrame:
    """Matches no further into the text than their phrase's limit."""
    limits = model.table(matches.sparkSession).where("role = 'phrase' and max_start >= 0").select(F.col("phrase").alias("_p"), "max_start")
    return matches.join(F.broadcast(limits), F.col("phrase") == F.col("_p"), "left").where("max_start is null or offset <= max_start").drop("_p", "max_start")


def overlapping(a: DataFrame, b: DataFrame, bucket: int = 256) -> DataFrame:
    """Pairs of matches of one document whose spans overlap; a's columns as left, b's as right.

    Spans are looked up by document and fixed buckets of offsets, so a document with many matches is no single group.
    """
    place = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}.offset") / bucket), F.floor((F.greatest(F.col(f"{c}.end"), F.col(f"{c}.offset") + 1) - 1) / bucket)))
    x = a.select(F.struct("*").alias("left")).select("left", place("left").alias("k"))
    y = b.select(F.struct("*").alias("right")).select("right", place("right").alias("k2"))
    on = (F.col("k") == F.col("k2")) & (F.col("left.doc_id") == F.col("right.doc_id")) & (F.col("left.offset") < F.col("right.end")) & (F.col("right.offset") < F.col("left.end"))
    first = F.floor(F.greatest(F.col("left.offset"), F.col("right.offset")) / bucket) == F.col("k")
    return x.join(y, on & first).select("left", "right")


def merged_ranges(matches: DataFrame) -> DataFrame:
    """doc_id, start, end, phrases of runs of matches that overlap or touch."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("offset", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("offset") > F.coalesce("_reach", F.lit(-1)), 1).otherwise(0)).over(w)
    runs = matches.withColumn("_reach", reach).withColumn("_run", island)
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("phrase", "variant")))))
    return runs.groupBy("doc_id", "_run").agg(F.min("offset").alias("start"), F.max("end").alias("end"), names.alias("phrases")).drop("_run")


__all__ = ["Match", "best_of_same_span", "combine", "exact_matches", "merged_ranges", "overlapping", "passing", "search_phrases", "search_slices", "within_offset"]
