"""Matches with their surroundings, and searching within them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.matching import Searcher
from marginalia.operators.phrase_search import ARROW, MATCH_FIELDS, map_texts, search_phrases
from marginalia.plans.config import SearchConfig, phrase_config
from marginalia.plans.model import PhraseModel


def add_context(matches: DataFrame, docs: DataFrame, prefix_size: int = 100, suffix_size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches with prefix, suffix, context, context_start and context_end, clamped to the text."""
    if prefix_size < 0 or suffix_size < 0:
        raise ValueError("context sizes must be zero or more")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    both = matches.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")))
    start = F.greatest(F.col("offset") - prefix_size, F.lit(0))
    end = F.least(F.col("end") + suffix_size, F.length("_text"))
    cut = lambda a, z: F.substring("_text", a + 1, F.greatest(z - a, F.lit(0)))
    return both.select(
        *matches.columns, start.cast("int").alias("context_start"), end.cast("int").alias("context_end"),
        cut(start, F.col("offset")).alias("prefix"), cut(F.col("end"), end).alias("suffix"), cut(start, end).alias("context"),
    )


def search_context(docs: DataFrame, model: PhraseModel, config: dict | SearchConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrase search with context_size characters around each match, cut where it is found; overlapping matches are allowed unless set otherwise."""
    settings = config if isinstance(config, SearchConfig) else phrase_config({"allow_overlapping_matches": True} | (config or {}))
    size = settings.context_size

    def make():
        searcher = Searcher(model, settings)

        def find(text: str) -> list[tuple]:
            out = []
            for m in searcher.search(text):
                start, end = max(m.offset - size, 0), min(m.end + size, len(text))
                out.append((*m, start, end, text[start : m.offset], text[m.end : end], text[start:end]))
            return out

        return find

    fields = f"{MATCH_FIELDS}, context_start int, context_end int, prefix string, suffix string, context string"
    types = [*ARROW, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    found = map_texts(docs, id_col, text_col, make, fields, types).withColumn("ignorecase", F.lit(settings.ignorecase))
    last = ["context_start", "context_end", "prefix", "suffix", "context"]
    return found.select(*[c for c in found.columns if c not in last], *last)


def search_within(contexts: DataFrame, model: PhraseModel, config: dict | SearchConfig | None = None) -> DataFrame:
    """Matches inside the contexts of other matches; offsets count in the whole text, source_offset tells the outer match."""
    settings = phrase_config(config)
    outer = contexts.select(F.struct("doc_id", "offset", "context_start").alias("key"), "context").where("context is not null")
    inner = search_phrases(outer, model, settings, "key", "context")
    shift = F.col("doc_id.context_start")
    cols = [c for c in inner.columns if c not in ("doc_id", "offset", "end")]
    return inner.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.offset").alias("source_offset"), *cols, (F.col("offset") + shift).alias("offset"), (F.col("end") + shift).alias("end"))
