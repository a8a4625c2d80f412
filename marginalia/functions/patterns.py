"""Patterns for Dutch names, places and dates, and their combination with context words, for regexp_extract_all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.scalar import escape

_CAPITALISED = r"[A-Z][\p{L}\p{N}_-]+"
_LINKS, _AFTER = ("van", "de", "der", "den"), ("de jonge", "de oude", "junior", "senior")
_any = lambda items: "|".join(items)
NAME = rf"{_CAPITALISED}(?: {_CAPITALISED})*(?: (?:{_any(_LINKS)}))*(?: {_CAPITALISED})+(?: (?:{_any(_AFTER)}))?"
PLACE = _CAPITALISED
WEEKDAY = _any(f"{d}dag" for d in ("maan", "dins", "woens", "donder", "vrij", "zater", "zon"))
#: Stem and how it may go on; a full stop marks an abbreviation.
_MONTHS = {"jan": ("uari", "."), "feb": ("ruari", "."), "maart": None, "mrt": None, "apr": ("il", "."), "mei": None, "jun": ("i",), "jul": ("i",), "aug": ("ustus", "."), "sep": ("tember", "t.", "t", "."), "okt": ("ober", "."), "nov": ("ember", "."), "dec": ("ember", ".")}
_MUST = {"apr"}
MONTH = _any(stem if ends is None else f"{stem}(?:{_any(escape(e) for e in ends)})" + ("" if stem in _MUST else "?") for stem, ends in _MONTHS.items())
_HOURS = "een twee drie vier vijf zes zeven acht negen tien elf twaalf".split()
DAY_MONTH = rf"(\d{{1,2}}) ({MONTH})"


@dataclass(frozen=True)
class Pattern:
    """A regular expression and the groups that hold what is looked for."""

    pattern: str
    groups: tuple[int, ...]
    type: str

    def extract(self, c: Column | str) -> list[Column]:
        """An array of all finds for each group."""
        c = F.col(c) if isinstance(c, str) else c
        return [F.regexp_extract_all(c, F.lit(self.pattern), F.lit(g)) for g in self.groups]


PATTERNS = {
    "name": Pattern(f"({NAME})", (1,), "dutch_person_name"),
    "name_and_name": Pattern(f"({NAME}) en ({NAME})", (1, 2), "dutch_person_name"),
    "name_sequence": Pattern(f"({NAME}), ?({NAME}) en ({NAME})", (1, 2, 3), "dutch_person_name"),
    "weekday_comma_day_month": Pattern(rf"({WEEKDAY}),? (?:(?:de|den) )?{DAY_MONTH}", (1, 2, 3), "dutch_date"),
    "day_month": Pattern(DAY_MONTH, (1, 2), "dutch_date"),
    "year": Pattern(r"(\d{4})", (1,), "dutch_date"),
    "time": Pattern(rf"\b(\d{{1,2}}|{_any(_HOURS)}) (uu?ren)\b", (1, 2), "dutch_date"),
    "day_part": Pattern(r"\b's (avonds|middags|ochtends)", (1,), "dutch_date"),
    "in_placename": Pattern(f"(in|tot) ({PLACE})", (1, 2), "dutch_place_name"),
}


def _after(p: Pattern, context: str, most: int = 10) -> Pattern:
    return Pattern(f"{p.pattern}.{{0,{most}}}{context}", p.groups, p.type)


def _before(p: Pattern, context: str, most: int = 10) -> Pattern:
    return Pattern(f"{context}.{{0,{most}}}{p.pattern}", p.groups, p.type)


def _comma(p: Pattern, context: str) -> Pattern:
    return Pattern(f"{p.pattern} ?, ?{context}", p.groups, p.type)


def _then(p: Pattern, context: str) -> Pattern:
    return Pattern(f"{context},? {p.pattern}", p.groups, p.type)


CONTEXTS: dict[str, dict[str, Callable[..., Pattern]]] = {
    "person_name": {"pattern_comma_then_context": _comma, "context_then_pattern": _then},
    "distance": {"pattern_before_context": _after, "context_before_pattern": _before},
}
CONTEXTS["all"] = {**CONTEXTS["person_name"], **CONTEXTS["distance"]}


def pattern_names(type: str | None = None) -> list[str]:
    return [n for n, p in PATTERNS.items() if type is None or p.type == type]


def search_patterns(type: str | None = None) -> dict[str, Pattern]:
    return {n: PATTERNS[n] for n in pattern_names(type)}


def context_patterns(type: str = "all") -> dict[str, Callable[..., Pattern]]:
    if type not in CONTEXTS:
        raise KeyError(f"unknown context type: {type}")
    return CONTEXTS[type]


def with_context(context: str, type: str | None = None, context_type: str = "all") -> dict[str, Pattern]:
    """Every pattern of a type combined with a literal context in each way of a context type."""
    made = {"pattern_comma_then_context": "{}_comma_then_context", "context_then_pattern": "context_then_{}", "pattern_before_context": "{}_before_context", "context_before_pattern": "context_before_{}"}
    return {made[k].format(n): f(p, escape(context)) for n, p in search_patterns(type).items() for k, f in context_patterns(context_type).items()}
