"""The phrase model: phrases, variants, distractors, labels, position limits and free metadata.

It is driver-side metadata, a few entries against a corpus of any size; as tables it has MODEL_LIMIT rows at most before a
search refuses to broadcast it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marginalia.functions.scalar import SkipGram, skipgrams

#: A search sends the model to every task, so it must stay small.
MODEL_LIMIT = 100_000
EARLY, LATE = 3, 3
WORDS = re.compile(r"\w+")
TOKENS = re.compile(r"\w+|[^\w\s]+")


def _strings(x) -> list[str]:
    if x is None:
        return []
    out = [x] if isinstance(x, str) else list(x)
    if not all(isinstance(s, str) for s in out):
        raise TypeError(f"expected strings, got {out!r}")
    return out


def _limit(x, name: str) -> int:
    if x is None or x == -1:
        return -1
    if not isinstance(x, int) or isinstance(x, bool) or x < 0:
        raise ValueError(f"{name} must be an integer of 0 or more")
    return x


@dataclass
class Phrase:
    """A phrase, variant or distractor with what a search looks up in it."""

    text: str
    labels: list[str] = field(default_factory=list)
    max_start: int = -1
    max_end: int = -1
    metadata: dict = field(default_factory=dict)
    ngram_size: int = 2
    skip_size: int = 2

    def __post_init__(self) -> None:
        self.skipgrams: list[SkipGram] = list(skipgrams(self.text, self.ngram_size, self.skip_size))
        self.late_threshold = len(self.text) - LATE - self.ngram_size
        self.distinct = len({g.string for g in self.skipgrams})
        self._cased = self._index(self.skipgrams)
        self._lower = None

    def _index(self, grams: list[SkipGram]) -> tuple[dict[str, int], set[str], set[str], dict[str, int]]:
        first: dict[str, int] = {}
        freq: dict[str, int] = {}
        for g in grams:
            first.setdefault(g.string, g.start)
            freq[g.string] = freq.get(g.string, 0) + 1
        return first, {g.string for g in grams if g.start < EARLY}, {g.string for g in grams if g.start + g.length > self.late_threshold}, freq

    def index(self, ignorecase: bool) -> tuple[dict[str, int], set[str], set[str], dict[str, int]]:
        """Skipgram -> first place; early ones; late ones; skipgram -> times."""
        if not ignorecase:
            return self._cased
        if self._lower is None:
            self._lower = self._index(list(skipgrams(self.text.lower(), self.ngram_size, self.skip_size)))
        return self._lower

    def has_skipgram(self, s: str) -> bool:
        return s in self._cased[0]

    def skipgram_offsets(self, s: str) -> list[int]:
        return [g.start for g in self.skipgrams if g.string == s]

    def is_early(self, s: str) -> bool:
        return s in self._cased[1]

    def within_range(self, a: str, b: str, most: int = 3) -> bool:
        """Whether two skipgrams stand at most so far apart somewhere in the phrase."""
        return any(abs(x - y) <= most for x in self.skipgram_offsets(a) for y in self.skipgram_offsets(b))

    def has_label(self, label: str) -> bool:
        return label in self.labels


class PhraseModel:
    """Phrases by string. Later additions of the same phrase replace earlier ones."""

    CORE = ("phrase", "variants", "distractors", "label", "labels", "max_start_offset", "max_end_offset", "metadata")

    def __init__(self, phrases: Iterable[str | dict] = (), ngram_size: int = 2, skip_size: int = 2):
        self.ngram_size, self.skip_size = ngram_size, skip_size
        self.phrases: dict[str, Phrase] = {}
        self.variants: dict[str, Phrase] = {}
        self.main_of: dict[str, str] = {}
        self.distractors: dict[str, list[str]] = {}
        self.add(phrases)

    # --- building ---

    def _phrase(self, text: str, **more) -> Phrase:
        if not isinstance(text, str) or not text:
            raise ValueError("a phrase must be a non-empty string")
        return Phrase(text, ngram_size=self.ngram_size, skip_size=self.skip_size, **more)

    def add(self, phrases: Iterable[str | dict]) -> "PhraseModel":
        entries = [{"phrase": p} if isinstance(p, str) else p for p in phrases]
        for e in entries:
            if not isinstance(e, dict) or not isinstance(e.get("phrase"), str):
                raise TypeError("a phrase must be a string or a dict with a string 'phrase'")
            self._fits(e["phrase"] not in self.phrases)
            known = {**e.get("metadata", {}), **{k: v for k, v in e.items() if k not in self.CORE}}
            self.phrases[e["phrase"]] = self._phrase(
                e["phrase"], labels=_strings(e.get("label", e.get("labels"))), max_start=_limit(e.get("max_start_offset"), "max_start_offset"), max_end=_limit(e.get("max_end_offset"), "max_end_offset"), metadata=known
            )
        for e in entries:
            self.add_variants(e["phrase"], _strings(e.get("variants")))
            self.add_distractors(e["phrase"], _strings(e.get("distractors")))
        return self

    def _fits(self, more: int) -> None:
        """Checked before anything is added."""
        self._entries = getattr(self, "_entries", 0) + more
        if self._entries > MODEL_LIMIT:
            raise ValueError(f"a model holds at most {MODEL_LIMIT} phrases, variants and distractors, as it goes to every task; search_slices() takes more")

    def add_variants(self, phrase: str, variants: Iterable[str]) -> None:
        main = self._main(phrase)
        for v in variants:
            self._fits(v not in self.variants)
            self.variants[v] = self._phrase(v, labels=list(main.labels), max_start=main.max_start, max_end=main.max_end, metadata=main.metadata)
            self.main_of[v] = phrase

    def add_distractors(self, phrase: str, distractors: Iterable[str]) -> None:
        self._main(phrase)
        have = self.distractors.setdefault(phrase, [])
        more = [d for d in dict.fromkeys(_strings(list(distractors))) if d not in have]
        self._fits(len(more))
        have += more

    def add_labels(self, phrase: str, labels: str | Iterable[str]) -> None:
        for p in [self._main(phrase), *(self.variants[v] for v in self.get_variants(phrase))]:
            p.labels += [x for x in _strings(labels) if x not in p.labels]

    def add_custom(self, phrase: str, metadata: dict) -> None:
        self._main(phrase).metadata.update(metadata)

    def _main(self, phrase: str) -> Phrase:
        if phrase not in self.phrases:
            raise KeyError(f"unknown phrase: {phrase}")
        return self.phrases[phrase]

    # --- removing ---

    def remove_phrases(self, phrases: Iterable[str]) -> None:
        """Phrases with their variants and distractors."""
        for p in list(phrases):
            self._main(p)
            self.remove_variants(self.get_variants(p))
            self._entries -= 1 + len(self.distractors.pop(p, ()))
            del self.phrases[p]

    def remove_variants(self, variants: Iterable[str] = (), of: str | None = None) -> None:
        for v in [*variants, *(self.get_variants(of) if of else [])]:
            del self.variants[v], self.main_of[v]
            self._entries -= 1

    def remove_distractors(self, distractors: Iterable[str] = (), of: str | None = None) -> None:
        gone = set(distractors)
        for p in list(self.distractors):
            left = [] if p == of else [d for d in self.distractors[p] if d not in gone]
            self._entries -= len(self.distractors[p]) - len(left)
            self.distractors[p] = left

    def remove_labels(self, phrase: str) -> None:
        self._main(phrase).labels = []

    def remove_custom(self, phrase: str) -> None:
        self._main(phrase).metadata = {}

    # --- looking up ---

    def has_phrase(self, p: str) -> bool:
        return p in self.phrases

    def get_phrases(self) -> list[str]:
        return list(self.phrases)

    def get_variants(self, phrase: str) -> list[str]:
        return [v for v, p in self.main_of.items() if p == phrase]

    def variant_of(self, variant: str) -> str | None:
        return self.main_of.get(variant)

    def get_labels(self, phrase: str) -> list[str]:
        return self._main(phrase).labels

    def is_label(self, label: str) -> bool:
        return any(label in p.labels for p in self.phrases.values())

    def get(self, phrase: str) -> dict:
        return self._main(phrase).metadata

    def phrases_up_to(self, length: int, include_variants: bool = False) -> list[str]:
        """Phrases of at most that many characters."""
        return [p for p in [*self.phrases, *(self.variants if include_variants else ())] if len(p) <= length]

    def entries(self, include_variants: bool = True) -> list[tuple[str, Phrase]]:
        """(main phrase, phrase or variant), a string that is both counting as a phrase."""
        out = [(p, x) for p, x in self.phrases.items()]
        return out + [(self.main_of[v], x) for v, x in self.variants.items() if v not in self.phrases] if include_variants else out

    def json(self) -> list[dict]:
        """What can build the model again, distractors included."""
        out = []
        for p, x in self.phrases.items():
            e: dict = {"phrase": p}
            if v := self.get_variants(p):
                e["variants"] = v
            if d := self.distractors.get(p):
                e["distractors"] = d
            if x.labels:
                e["label"] = x.labels[0] if len(x.labels) == 1 else x.labels
            if x.max_start >= 0:
                e["max_start_offset"] = x.max_start
            if x.max_end >= 0:
                e["max_end_offset"] = x.max_end
            if x.metadata:
                e["metadata"] = x.metadata
            out.append(e)
        return out

    # --- tables ---

    def table(self, spark: SparkSession) -> DataFrame:
        """phrase, role (phrase, variant or distractor), main, labels, max_start, max_end, length."""
        rows = [(p, "phrase", p, x.labels, x.max_start, x.max_end, len(p)) for p, x in self.phrases.items()]
        rows += [(v, "variant", self.main_of[v], x.labels, x.max_start, x.max_end, len(v)) for v, x in self.variants.items()]
        rows += [(d, "distractor", p, [], -1, -1, len(d)) for p, ds in self.distractors.items() for d in ds]
        return spark.createDataFrame(rows, "phrase string, role string, main string, labels array<string>, max_start int, max_end int, length int")

    def skipgram_table(self, spark: SparkSession) -> DataFrame:
        """phrase, sg, first_start, freq, is_early, is_late of phrases and variants."""
        rows = []
        for _, x in self.entries():
            first, early, late, freq = x.index(False)
            rows += [(x.text, g, first[g], freq[g], g in early, g in late) for g in first]
        return spark.createDataFrame(rows, "phrase string, sg string, first_start int, freq int, is_early boolean, is_late boolean")

    def tokens(self) -> list[tuple[str, str, int, int]]:
        """(token, phrase, least and largest character offset in it) of phrases and variants."""
        out: dict[tuple[str, str], list[int]] = {}
        for _, x in self.entries():
            for m in TOKENS.finditer(x.text):
                out.setdefault((m[0], x.text), []).append(m.start())
        return [(t, p, min(o), max(o)) for (t, p), o in out.items()]

    def token_caps(self, ends: bool = False) -> dict[str, int]:
        """Largest offset of a token from the text's start (or end): only where every phrase that has it sets a limit."""
        by: dict[str, list[tuple[int, int]]] = {}
        known = {x.text: x for _, x in self.entries()}
        for t, p, low, high in self.tokens():
            x = known[p]
            by.setdefault(t, []).append((x.max_end, low) if ends else (x.max_start, high))
        return {t: max(a + b for a, b in rows) for t, rows in by.items() if all(a >= 0 for a, _ in rows)}
