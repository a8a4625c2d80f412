"""License scans: ordered signature rules with a keyword prefilter.

A text's words, lower-cased and joined by single spaces, pass one Aho-Corasick scan for the rules' keywords; only rules whose
keyword is there run. Detections are resolved in order of priority, then length: one that lies within an interval already
kept is suppressed. So a full notice hides the names in it, and "gnu lesser general public license" hides the "general public
license" in it, while a licence named elsewhere stays.

Base phrases are counted apart and always stay. The score is the chance that at least one detection is right, taking them as
independent; 0 if there is none.

Nulls: a null text is an empty one. Empty tables give empty results, repeated rows repeated ones; other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, map_docs, table
from .license_rules import CONFIDENCE, rules

BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}
_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def normal(text: bytes) -> tuple[bytes, int]:
    """The words of a UTF-8 text with a space before, between and after them, and their number."""
    words = text.translate(_TO_SPACE).split()
    return b" " + b" ".join(words) + b" ", len(words)


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(word, label) of every place where a base phrase stands, by word; text: normal()."""
    out = []
    for phrase, label in BASE.items():
        phrase = b" " + phrase + b" "
        at, word, done = text.find(phrase), 0, 0
        while at >= 0:
            word, done = word + text.count(b" ", done, at), at
            out.append((word, label))
            at = text.find(phrase, at + 1)
    return sorted(out)


class Intervals:
    """Intervals, of which only those within no other are kept: by start, so by end as well."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def cover(self, start: int, end: int) -> bool:
        """Whether one of them contains this one."""
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end

    def add(self, start: int, end: int) -> None:
        """Adds one that none of them contains."""
        i, j = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[i : max(i, j)], self.ends[i : max(i, j)] = [start], [end]


class Matcher:
    """The compiled rules and the automaton of their keywords."""

    def __init__(self, table_: list[tuple[int, str, str, str]]):
        self.rules, self.by_keyword = [], {}
        for i, (priority, label, keyword, regex) in enumerate(table_):
            self.rules.append((priority, label, re.compile(f"(?<= )(?:{regex.strip()})(?= )")))
            self.by_keyword.setdefault(keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword in self.by_keyword:
            for form in {keyword, keyword.replace("license", "licence"), keyword.replace("licence", "license")}:
                self.automaton.add_word(f" {form}", keyword)  # its last word may go on
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """Kept detections (start, end, label, priority, rule) by start; text: normal(), decoded."""
        found = {k for _, k in self.automaton.iter(text)}
        if not found:
            return []
        hits = []
        for k in found:
            for i in self.by_keyword[k]:
                priority, label, regex = self.rules[i]
                hits += [(priority, m.start() - m.end(), m.start(), m.end(), label, i) for m in regex.finditer(text)]
        kept: list[tuple[int, int, str, int, int]] = []
        seen = Intervals()
        for priority, _, start, end, label, i in sorted(hits, key=lambda h: (h[0], h[1], h[2], h[5])):
            if not seen.cover(start, end):
                seen.add(start, end)
                kept.append((start, end, label, priority, i))
        return sorted(kept)


@cache
def matcher() -> Matcher:
    return Matcher(rules())


def score(detections: list[tuple]) -> float:
    miss = 1.0
    for d in detections:
        miss *= 1 - CONFIDENCE[d[3]]
    return 1 - miss


KIND = "array<struct<label:string,start:long,end:long,priority:int,text:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, detections (label, first and last word + 1, priority, matched words), score. No shuffle."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("text", pa.string())]))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out, scores = [], []
        for t in as_bytes(b, text_col):
            text = normal(t)[0].decode()
            kept = matcher().detections(text)
            rows, first, done = [], -1, 0
            for start, end, label, priority, _ in kept:
                first, done = first + text.count(" ", done, start), start
                rows.append({"label": label, "start": first, "end": first + text.count(" ", start, end) + 1, "priority": priority, "text": text[start:end]})
            out.append(rows)
            scores.append(score(kept))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind), pa.array(scores, pa.float64())], names=["doc_id", "detections", "score"])

    return map_docs(docs, [id_col, text_col], each, f"doc_id long, detections {KIND}, score double")


DIGEST = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document (see DIGEST): base phrases, and the labels and score of all detections."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in as_bytes(b, text_col):
            text, n = normal(t)
            base = base_places(text)
            kept = matcher().detections(text.decode())
            mine = {label for _, label in base}
            rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(mine)), ",".join(sorted(mine | {d[2] for d in kept})), score(kept), len(kept)))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return map_docs(docs, [id_col, text_col], each, DIGEST)


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_digest() of all documents: a row each, repeated rows too. Null and empty texts hold nothing and score 0; an empty table gives no rows."""
    return license_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_rules": op2_license_rules}
SQL: dict[str, str] = {}
