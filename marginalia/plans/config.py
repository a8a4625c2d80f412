"""Search settings. Phrase and token search have different defaults for the same names."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from marginalia.functions.scalar import PUNCTUATION


@dataclass(frozen=True)
class SearchConfig:
    char_match_threshold: float = 0.5
    ngram_threshold: float = 0.5
    levenshtein_threshold: float = 0.5
    skipgram_threshold: float = 0.2
    max_length_variance: int = 1
    use_word_boundaries: bool = True
    ignorecase: bool = False
    include_variants: bool = False
    filter_distractors: bool = False
    skip_exact_matching: bool = False
    allow_overlapping_matches: bool = False
    first_best: bool = False
    ngram_size: int = 2
    skip_size: int = 2
    punctuation: str = PUNCTUATION
    context_size: int = 100
    max_char_gap: int = 20
    max_token_gap: int = 1

    def __post_init__(self) -> None:
        if self.ngram_size <= 0 or self.skip_size < 0:
            raise ValueError("ngram_size must be positive and skip_size zero or more")
        for name in ("char_match_threshold", "ngram_threshold", "levenshtein_threshold", "skipgram_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")


#: Where token search differs.
TOKEN_DEFAULTS = {"char_match_threshold": 0.6, "levenshtein_threshold": 0.6, "use_word_boundaries": False}


def _known(settings: dict | None) -> dict:
    names = {f.name for f in fields(SearchConfig)}
    if unknown := set(settings or {}) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return settings or {}


def phrase_config(settings: dict | SearchConfig | None = None) -> SearchConfig:
    return settings if isinstance(settings, SearchConfig) else SearchConfig(**_known(settings))


def token_config(settings: dict | SearchConfig | None = None) -> SearchConfig:
    return settings if isinstance(settings, SearchConfig) else replace(SearchConfig(), **TOKEN_DEFAULTS | _known(settings))
