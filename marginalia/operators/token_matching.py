"""Token-based phrase search in one text: what runs per row inside an Arrow UDF.

Text tokens are compared with phrase tokens by shared skipgrams, once per distinct token; token matches are then chained into
phrases. A chain that several tokens could extend is copied, but chains of the same tokens are kept once, so their number stays
that of distinct token sequences.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from marginalia.functions.scalar import indel_ratio, is_distractor, token_skipgrams
from marginalia.operators.matching import Match
from marginalia.plans.config import SearchConfig
from marginalia.plans.model import TOKENS, Phrase, PhraseModel

NONE, PART_OF_PHRASE_TOKEN, FULL, PART_OF_TEXT_TOKEN = "none", "partial_of_phrase_token", "full", "partial_of_text_token"
#: A phrase may begin with a token so far into it; parts of a phrase token may lie so far apart.
FIRST_WITHIN, PART_GAP = 5, 4
#: Splits a text into what lies between tokens and tokens, in turn.
PIECES = re.compile(f"({TOKENS.pattern})")
#: Distinct text tokens whose kinds of match a task remembers.
REMEMBERED = 400_000


class Token(NamedTuple):
    n: str
    index: int
    at: int
    to_end: int

    @property
    def end(self) -> int:
        return self.at + len(self.n)


class TokenMatch(NamedTuple):
    tokens: tuple[Token, ...]
    phrase_token: str
    kind: str
    start: int
    end: int


class Chain(NamedTuple):
    """Token matches that may make up a phrase, in text order; each begins behind the end of the one before."""

    matches: tuple[TokenMatch, ...]
    missing: tuple[str, ...]
    start: int
    end: int

    @property
    def tokens(self) -> list[Token]:
        return [t for m in self.matches for t in m.tokens]


def without(parts: tuple[str, ...], token: str) -> tuple[str, ...]:
    """Parts of a phrase without the first that is the token."""
    i = parts.index(token)
    return parts[:i] + parts[i + 1 :]


class Kinds(dict):
    """Text token -> its kinds of match, found when they are first asked for."""

    def __init__(self, find: Callable[[str], list[tuple[str, str]]]):
        self.find = find

    def __missing__(self, token: str) -> list[tuple[str, str]]:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[token] = self.find(token)
        return out


def tokens_of(text: str, ignorecase: bool = False) -> list[Token]:
    return [Token(m[0].lower() if ignorecase else m[0], i, m.start(), len(text) - (m.end() + 1)) for i, m in enumerate(TOKENS.finditer(text))]


class TokenSearcher:
    """A model prepared for token search. vocabulary: known words, which may rule out phrase tokens that they merely resemble."""

    def __init__(self, model: PhraseModel, config: SearchConfig, vocabulary: list[str] | None = None):
        self.model, self.config = model, config
        self.variance = config.max_length_variance
        fold = str.lower if config.ignorecase else str
        self.phrases: dict[str, tuple[Phrase, str]] = {}
        for role, items in (("distractor", [d for ds in model.distractors.values() for d in ds]), ("variant", model.variants), ("phrase", model.phrases)):
            for p in items:
                x = model.phrases.get(p) or model.variants.get(p) or Phrase(p, ngram_size=model.ngram_size, skip_size=model.skip_size)
                self.phrases[p] = (x, role)
        self.parts = {p: tuple(fold(m[0]) for m in TOKENS.finditer(p)) for p in self.phrases}
        self.first_at: dict[str, dict[str, int]] = defaultdict(dict)  # token -> phrase -> least offset in it
        for p in self.phrases:
            for m in TOKENS.finditer(p):
                self.first_at[fold(m[0])].setdefault(p, m.start())
        #: Phrase token -> its phrases, whether they may begin with it, their other parts, and how long a chain may get.
        self.uses = {t: [(p, at < FIRST_WITHIN, without(self.parts[p], t), len(p) + self.variance) for p, at in ps.items()] for t, ps in self.first_at.items()}
        self.gram_index: dict[str, list[str]] = defaultdict(list)
        self.n_grams: dict[str, int] = {}
        for t in self.first_at:
            grams = self._grams(t)
            self.n_grams[t] = len(grams)
            for g in dict.fromkeys(g.string for g in grams):
                self.gram_index[g].append(t)
        self.start_caps, self.end_caps = ({fold(t): x for t, x in model.token_caps(ends).items()} for ends in (False, True))
        self.distractor_pairs: set[tuple[tuple[str, ...], str]] = set()
        self.match_pairs: set[tuple[str, str]] = set()
        for term in dict.fromkeys(fold(v) for v in vocabulary or ()):
            for p in self._sharing(term):
                if is_distractor(term, p):
                    self.distractor_pairs.add(((term,), p))
                else:
                    self.match_pairs.add((term, p))
        self._kinds = Kinds(self._find_kinds)

    def add_distractor_pair(self, text_tokens: tuple[str, ...], phrase_token: str) -> None:
        self.distractor_pairs.add((text_tokens, phrase_token))
        self._kinds.clear()

    def _grams(self, token: str):
        return list(token_skipgrams(token, self.config.ngram_size, self.config.skip_size, pad=False))

    def _sharing(self, token: str) -> list[str]:
        return list(dict.fromkeys(p for g in self._grams(token) for p in self.gram_index.get(g.string, ())))

    def kinds(self, token: str) -> list[tuple[str, str]]:
        """(phrase token, kind of match) of the phrase tokens that a text token may stand for; computed once per token."""
        return self._kinds[token]

    def _shared(self, token: str) -> tuple[int, dict[str, list]]:
        """The number of a token's skipgrams, and by phrase token: start of the first shared one, end of the last, the set of them."""
        index, out, size = self.gram_index, {}, len(token)
        if self.config.ngram_size != 2 or size <= 2:
            grams = self._grams(token)
            for g in grams:
                for p in index.get(g.string, ()):
                    x = out.setdefault(p, [g.start, 0, set()])
                    x[1] = g.start + g.length
                    x[2].add(g.string)
            return len(grams), out
        reach, n = self.config.skip_size + 2, 0
        for at, first in enumerate(token):
            others = token[at + 1 : at + reach]
            n += len(others)
            for d, c in enumerate(others, at + 2):
                if (g := first + c) in index:
                    for p in index[g]:
                        if p in out:
                            x = out[p]
                            x[1] = d
                            x[2].add(g)
                        else:
                            out[p] = [at, d, {g}]
        return n, out

    def _find_kinds(self, token: str) -> list[tuple[str, str]]:
        size, out, least = len(token), [], self.config.skipgram_threshold
        n_grams, shared = self._shared(token)
        for p, (start, end, found) in shared.items():
            if self.distractor_pairs and ((token,), p) in self.distractor_pairs:
                continue
            of_text, of_phrase = len(found) / n_grams, len(found) / self.n_grams[p]
            if of_text < least and of_phrase < least or (size if of_text > of_phrase else len(p)) - (end - start) > self.variance:
                continue
            gap = size - len(p)
            out.append((p, FULL if abs(gap) <= self.variance else PART_OF_PHRASE_TOKEN if gap < 0 else PART_OF_TEXT_TOKEN))
        return out

    def likely_tokens(self, text: str) -> list[Token]:
        """The tokens of a text that may stand for one of a phrase."""
        pieces, size, kinds = PIECES.split(text), len(text), self._kinds
        words = pieces[1::2]
        names = [w.lower() for w in words] if self.config.ignorecase else words
        ends = list(accumulate(map(len, pieces)))[1::2]
        return [Token(n, i, ends[i] - len(words[i]), size - (ends[i] + 1)) for i, n in enumerate(names) if kinds[n]]

    def token_matches(self, tokens: list[Token]) -> list[TokenMatch]:
        out, pending = [], defaultdict(list)  # pending: text tokens that may be parts of a phrase token
        kinds, ruled_out, limited = self._kinds, self.distractor_pairs, self.start_caps.keys() | self.end_caps.keys()
        for t in tokens:
            at, end = t.at, t.end
            for p, kind in kinds[t.n]:
                if p in limited and (at > self.start_caps.get(p, at) or t.to_end > self.end_caps.get(p, t.to_end)):
                    continue
                if kind != PART_OF_PHRASE_TOKEN:
                    out.append(TokenMatch((t,), p, kind, at, end))
                    continue
                parts = pending[p]
                if parts and at - parts[-1].end > PART_GAP:
                    parts.clear()
                if ruled_out and (tuple(x.n for x in [*parts, t]), p) in ruled_out:
                    continue
                parts.append(t)
                if len(parts) > 1:
                    gap = end - parts[0].at - len(p)
                    if gap > 0 or abs(gap) <= self.variance:
                        out.append(TokenMatch(tuple(parts), p, kind, parts[0].at, end))
                        parts.pop(0)
        return out

    def chains(self, matches: list[TokenMatch]) -> dict[str, list[Chain]]:
        """Chains of token matches by phrase, those of about its length; complete ones alone where there are any."""
        open_: dict[str, list[tuple]] = {}  # the fields of chains
        done: dict[str, list[Chain]] = defaultdict(list)
        whole: set[str] = set()
        most_gap, variance, uses = self.config.max_char_gap, self.variance, self.uses

        def close(p: str, c: tuple) -> None:
            own = done[p]
            if not c[1]:
                whole.add(p)
            if abs(c[3] - c[2] - len(p)) <= variance:
                own.append(Chain(*c))

        for m in matches:
            token, start, end = m.phrase_token, m.start, m.end
            for p, may_begin, others, most in uses[token]:
                chains, added, late = open_.get(p), None, False
                if chains:
                    for c in chains:
                        gap = start - c[3]
                        if gap > most_gap:
                            late = True
                            close(p, c)
                        elif gap > 0 and end - c[2] <= most and token in c[1]:
                            longer = ((*c[0], m), without(c[1], token), c[2], end)
                            added = [longer] if added is None else [*added, longer]
                    if late:
                        open_[p] = chains = [c for c in chains if start - c[3] <= most_gap]
                if added:
                    chains += added
                elif may_begin:
                    fresh = ((m,), others, start, end)
                    if chains is None:
                        open_[p] = [fresh]
                    else:
                        chains.append(fresh)
        for p, chains in open_.items():
            for c in chains:
                close(p, c)
        return {p: [c for c in chains if not (p in whole and c.missing)] for p, chains in done.items()}

    def search(self, text: str) -> list[Match]:
        """The best phrase at each start; where a distractor is best, none."""
        best: dict[int, tuple[float, str, str, Chain]] = {}
        for p, chains in sorted(self.chains(self.token_matches(self.likely_tokens(text))).items()):
            for c in sorted(chains, key=lambda c: (c.start, c.end)):
                s = " ".join(t.n for t in c.tokens)
                off = abs(len(s) - len(p))
                if off > self.variance and (abs(c.end - c.start - len(p)) > self.variance or 1 - off / len(p) < self.config.levenshtein_threshold):
                    continue
                score = indel_ratio(p.lower() if self.config.ignorecase else p, s)
                if score >= self.config.levenshtein_threshold and (c.start not in best or score > best[c.start][0]):
                    best[c.start] = (score, p, s, c)
        out = []
        for at, (score, p, s, _) in sorted(best.items()):
            x, role = self.phrases[p]
            if role == "distractor":
                continue
            main = p if role == "phrase" else self.model.main_of[p]
            most = self.model.phrases[main].max_start
            if most < 0 or at <= most:
                out.append(Match(main, p, s, at, at + len(s), x.labels, None, None, None, score, s == p))
        return out

    def text_ends(self, text: str) -> dict[int, int]:
        """Start -> end in the text of the chains that search() picks from."""
        return {c.start: c.end for cs in self.chains(self.token_matches(self.likely_tokens(text))).values() for c in cs}
