"""Template matching: which runs of a document's labelled matches fit a template.

Sequences are found per document from its matches in text order; whole documents are rows, so there is no shuffle after a search.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.matching import Searcher
from marginalia.operators.phrase_search import id_type, map_texts
from marginalia.plans.config import SearchConfig, phrase_config
from marginalia.plans.model import PhraseModel
from marginalia.plans.template import Element, Template


@dataclass
class Sequence:
    """Matches start .. end - 1 that fit an element; parts: of a group's elements."""

    element: Element
    start: int
    end: int
    parts: list["Sequence"] = field(default_factory=list)


def _run(labels: list[set[str]], e: Element, at: int) -> Sequence | None:
    """The next longest run of matches with a label."""
    start = next((i for i in range(at, len(labels)) if e.label in labels[i]), None)
    if start is None:
        return None
    end = next((i for i in range(start, len(labels)) if e.label not in labels[i]), len(labels))
    return Sequence(e, start, end)


def _ordered(labels: list[set[str]], group: Element, at: int) -> Sequence | None:
    out, fixed = Sequence(group, at, at), False
    for e in group.elements or ():
        part = find(labels, e, out.end) if e.is_group else _run(labels, e, out.start)
        if part is None:
            if e.required:
                return None
            continue
        if out.start == out.end:
            out = Sequence(group, part.start, part.end, [part])
            fixed = fixed or e.required
        elif part.start <= out.end:
            out.parts.append(part)
            out.end = max(out.end, part.end)
        elif e.required:
            if fixed:
                return None
            out, fixed = Sequence(group, part.start, part.end, [part]), True
    return out


def _unordered(labels: list[set[str]], group: Element, at: int) -> Sequence | None:
    parts = []
    for e in group.elements or ():
        part = find(labels, e, at) if e.is_group else _run(labels, e, at)
        if part is not None:
            parts.append(part)
        elif e.required:
            return None
    out = None
    for part in sorted(parts, key=lambda p: p.start):
        if out is None:
            out = Sequence(group, part.start, part.end, [part])
        elif part.start <= out.end:
            out.parts.append(part)
            out.end = max(out.end, part.end)
        elif part.element.required:
            out = Sequence(group, part.start, part.end, [part])
        else:
            break
    return out


def find(labels: list[set[str]], group: Element, at: int) -> Sequence | None:
    """The next sequence that fits a group; an unordered group goes on while another sequence follows directly."""
    if group.ordered:
        return _ordered(labels, group, at)
    out = _unordered(labels, group, at)
    while out is not None:
        more = _unordered(labels, group, out.end)
        if more is None or more.start != out.end or more.end <= out.end:
            break
        out.end = more.end
        out.parts += more.parts
    return out


def sequences(labels: list[set[str]], template: Template) -> list[Sequence]:
    """All sequences of a document, one after the other."""
    out, at = [], 0
    while at < len(labels):
        s = find(labels, template.root, at)
        if s is None or s.end <= at:
            break
        out.append(s)
        at = s.end
    return out


def _leaves(s: Sequence, path: tuple[str, ...] = ()) -> list[tuple[str, list[str], int, int]]:
    """(label, labels of the groups around it, start, end) of label elements."""
    if not s.element.is_group:
        return [(s.element.label or "", list(path), s.start, s.end)]
    inner = (*path, s.element.label) if s.element.label else path
    return [x for p in s.parts for x in _leaves(p, inner)]


FIELDS = "template string, seq int, start_idx int, end_idx int, elements array<struct<label:string,label_groups:array<string>,offsets:array<int>,phrases:array<string>,strings:array<string>>>"
_ELEMENT = pa.struct([("label", pa.string()), ("label_groups", pa.list_(pa.string())), ("offsets", pa.list_(pa.int32())), ("phrases", pa.list_(pa.string())), ("strings", pa.list_(pa.string()))])
_ARROW = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(_ELEMENT)]


def fit(matches: list[tuple[int, list[str], str, str]], template: Template) -> list[tuple]:
    """Template matches of one document. matches: (offset, labels, phrase, string)."""
    rows = sorted(matches, key=lambda m: m[0])
    have = {x for m in rows for x in m[1]}
    if not have.issuperset(template.required_labels()):
        return []
    rows = [m for m in rows if template.has_label(list(m[1]))]
    out = []
    for k, s in enumerate(sequences([set(m[1]) for m in rows], template)):
        elements = [{"label": x, "label_groups": g, "offsets": [m[0] for m in rows[a:z]], "phrases": [m[2] for m in rows[a:z]], "strings": [m[3] for m in rows[a:z]]} for x, g, a, z in _leaves(s)]
        out.append((template.name, k, s.start, s.end, elements))
    return out


def search_templates(docs: DataFrame, template: Template, model: PhraseModel, config: dict | SearchConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Template matches of documents: searched and fitted in one narrow stage."""
    settings = config if isinstance(config, SearchConfig) else phrase_config({"allow_overlapping_matches": True} | (config or {}))

    def make():
        searcher = Searcher(model, settings)
        return lambda text: fit([(m.offset, m.labels, m.phrase, m.string) for m in searcher.search(text)], template)

    return map_texts(docs, id_col, text_col, make, FIELDS, _ARROW)


def fit_templates(matches: DataFrame, template: Template) -> DataFrame:
    """Template matches from a table of matches (doc_id, offset, labels, phrase, string); a document's matches make one row."""
    kept = matches.join(required_documents(matches, template), "doc_id", "left_semi") if template.required_labels() else matches
    one = kept.where(shares_label(F.col("labels"), template)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("offset", "labels", "phrase", "string"))).alias("m"))

    def run(it):
        for b in it:
            ids, rows = [], []
            for i, ms in enumerate(b.column(1).to_pylist()):
                got = fit([(m["offset"], m["labels"] or [], m["phrase"], m["string"]) for m in ms], template)
                ids += [i] * len(got)
                rows += got
            if rows:
                names = ["doc_id", *(f.split()[0] for f in ("template string", "seq int", "start_idx int", "end_idx int", "elements x"))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)]], names=names)

    return one.mapInArrow(run, f"doc_id {id_type(one, 'doc_id')}, {FIELDS}")


def shares_label(labels: Column, template: Template) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(x) for x in template.labels]))


def required_documents(matches: DataFrame, template: Template) -> DataFrame:
    """doc_id of documents whose matches have all required labels."""
    need = template.required_labels()
    found = matches.select("doc_id", F.explode("labels").alias("label")).where(F.col("label").isin(need))
    return found.groupBy("doc_id").agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(need)).select("doc_id")
