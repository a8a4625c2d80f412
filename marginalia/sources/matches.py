"""Matches as JSON and as web annotations, and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.model import PhraseModel

CONTEXT = "http://www.w3.org/ns/" + "anno.jsonld"
FIELDS = ("phrase", "variant", "string", "offset", "end", "label", "text_id", "match_scores", "context", "prefix", "suffix", "context_start", "context_end")
SCHEMA = (
    "phrase string, variant string, string string, offset int, end int, label array<string>, text_id string, "
    "match_scores struct<char_match double, ngram_match double, levenshtein_similarity double>, "
    "context string, prefix string, suffix string, context_start int, context_end int"
)


def to_json(matches: DataFrame) -> DataFrame:
    """doc_id, json; context fields only where the matches have them, and not where they are null."""
    scores = F.struct("char_match", "ngram_match", "levenshtein_similarity").alias("match_scores")
    more = [c for c in ("context", "prefix", "suffix", "context_start", "context_end") if c in matches.columns]
    body = F.struct("phrase", "variant", "string", "offset", "end", F.col("labels").alias("label"), F.col("doc_id").cast("string").alias("text_id"), scores, *more)
    return matches.select("doc_id", F.to_json(body).alias("json"))


def from_json(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Matches from to_json(), without computing scores anew; unreadable rows give null fields."""
    x = rows.select(F.from_json(json_col, SCHEMA).alias("m"))
    return x.select(F.col("m.text_id").alias("doc_id"), "m.phrase", "m.variant", "m.string", "m.offset", "m.end", F.col("m.label").alias("labels"), "m.match_scores.*", "m.context", "m.prefix", "m.suffix", "m.context_start", "m.context_end")


def _body(kind: str, value: Column, when: Column | None = None) -> Column:
    one = F.struct(F.lit("TextualBody").alias("type"), F.lit(kind).alias("purpose"), value.alias("value"))
    return one if when is None else F.when(when, one)


def to_web_annotations(matches: DataFrame) -> DataFrame:
    """doc_id, annotation: JSON of a web annotation with a body for tagging, highlighting, and, where they apply, correcting and
    classifying; the selector is the position, joined by the quote where the matches have context. Needs document ids."""
    bodies = F.filter(
        F.array(
            _body("tagging", F.col("phrase")), _body("highlighting", F.col("string")), _body("correcting", F.col("variant"), F.col("variant") != F.col("string")),
            _body("classifying", F.array_join("labels", ","), F.size("labels") > 0),
        ),
        lambda b: b.isNotNull(),
    )
    position = F.struct(F.lit("TextPositionSelector").alias("type"), F.col("offset").alias("start"), F.col("end").alias("end"))
    if "prefix" in matches.columns:
        selector = F.concat(F.lit("["), F.to_json(position), F.lit(","), F.to_json(F.struct(F.lit("TextQuoteSelector").alias("type"), "prefix", F.col("string").alias("exact"), "suffix")), F.lit("]"))
    else:
        selector = F.to_json(position)
    text = F.concat(
        F.lit('{"motivation":"classifying","type":"Annotation","@context":"' + CONTEXT + '","body":'), F.to_json(bodies),
        F.lit(',"target":{"source":'), F.to_json(F.array(F.col("doc_id").cast("string"))), F.lit(',"selector":'), selector, F.lit("}}"),
    )
    checked = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("an annotation needs a document id"))).otherwise(text)
    return matches.select("doc_id", checked.alias("annotation"))


def write_model(model: PhraseModel, path: str) -> None:
    """A model as a JSON file on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model.json(), f, ensure_ascii=False)


def read_model(path: str, **sizes) -> PhraseModel:
    with open(path, encoding="utf-8") as f:
        return PhraseModel(json.load(f), **sizes)


def documents(spark: SparkSession, texts) -> DataFrame:
    """doc_id, text from strings, (id, text) pairs or {"id", "text"} dicts; a string without id gets its place as id."""
    rows = []
    for i, t in enumerate(texts):
        if isinstance(t, str):
            rows.append((str(i), t))
        elif isinstance(t, dict):
            rows.append((None if t.get("id") is None else str(t["id"]), t["text"]))
        elif isinstance(t, (tuple, list)) and len(t) == 2:
            rows.append((None if t[0] is None else str(t[0]), t[1]))
        else:
            raise TypeError(f"not a document: {t!r}")
    return spark.createDataFrame(rows, "doc_id string, text string")
