"""Token-based phrase search over a DataFrame, and the token-level pair table as plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.operators.phrase_search import ARROW, MATCH_FIELDS, map_texts
from marginalia.operators.token_matching import TokenSearcher
from marginalia.plans.config import SearchConfig, token_config
from marginalia.plans.model import MODEL_LIMIT, PhraseModel


def search_tokens(
    docs: DataFrame, model: PhraseModel, config: dict | SearchConfig | None = None, vocabulary: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Matches by tokens: string is the matched tokens joined by spaces. The vocabulary goes to every task and is bounded like a model."""
    c = token_config(config)
    if vocabulary is not None and len(vocabulary) > MODEL_LIMIT:
        raise ValueError(f"a vocabulary holds at most {MODEL_LIMIT} terms")

    def make():
        searcher = TokenSearcher(model, c, vocabulary)
        return searcher.search

    return map_texts(docs, id_col, text_col, make, MATCH_FIELDS, ARROW).withColumn("ignorecase", F.lit(c.ignorecase))


def token_pairs(terms: DataFrame, phrase_tokens: DataFrame, n: int = 2, skip: int = 2, most: int = 2) -> DataFrame:
    """term, token, is_distractor of every vocabulary term and phrase token that share a skipgram.

    An equi-join on skipgrams of distinct terms, so its size follows the vocabulary and not the texts.
    """
    grams = lambda df, c: df.select(c).distinct().select(c, F.explode(F.array_distinct(F.transform(C.skipgrams(c, n, skip), lambda g: g["sg"]))).alias("sg"))
    pairs = grams(terms, "term").join(grams(phrase_tokens, "token"), "sg").select("term", "token").distinct()
    return pairs.withColumn("is_distractor", C.is_distractor("term", "token", most))
