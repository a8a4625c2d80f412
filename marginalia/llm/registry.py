"""Every registered training-data query and its SQL."""

from __future__ import annotations

import corpus_pipeline

from . import cotraining, licenses, line_dedup, mixing, mpeg, packing, quality_rules, secrets, simhash, toxicity

MODULES = [cotraining, licenses, packing, mixing, mpeg, simhash, secrets, quality_rules, line_dedup, toxicity]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {k: q for m in MODULES for k, q in m.SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
