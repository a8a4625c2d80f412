"""Fuzzy phrase search in one text: what runs per row inside an Arrow UDF.

Only positions whose skipgram is in the model are visited: skipgrams of all positions are coded as integers and looked up in
one vector operation. Matching skipgrams then grow candidates per phrase in text order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np

from marginalia.functions import scalar
from marginalia.functions.scalar import SkipGram, indel_ratio, skip_offsets
from marginalia.operators.boundaries import snap
from marginalia.plans.config import SearchConfig
from marginalia.plans.model import EARLY, WORDS, Phrase, PhraseModel

#: Look-up arrays of skipgrams have at most so many entries; ends of a candidate move outwards so far at most.
TABLE, SNAP = 1 << 22, 2


class Match(NamedTuple):
    phrase: str
    variant: str
    string: str
    offset: int
    end: int
    labels: list[str]
    char_match: float
    ngram_match: float
    skipgram_overlap: float
    levenshtein_similarity: float
    is_exact: bool


class Candidate(NamedTuple):
    phrase: Phrase
    start: int
    end: int
    string: str
    overlap: float


class Found(NamedTuple):
    """A phrase's skipgrams in a text: places, lengths and kinds (places in names), and where the text may hold a match of it."""

    phrase: Phrase
    starts: np.ndarray
    lengths: np.ndarray
    kinds: np.ndarray
    names: list[str]
    hot: np.ndarray | None


class Searcher:
    """A model prepared for searching texts."""

    def __init__(self, model: PhraseModel, config: SearchConfig):
        if (model.ngram_size, model.skip_size) != (config.ngram_size, config.skip_size):
            raise ValueError("the model was built for other skipgram sizes")
        self.model, self.config = model, config
        self.first_words: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for _, p in model.entries():
            if m := WORDS.search(p.text):
                self.first_words[m[0]].append((p.text, m.start()))
        self.mains = {p.text: main for main, p in model.entries()}
        self.by_gram: dict[str, list[Phrase]] = defaultdict(list)
        self.searched = [p for _, p in model.entries(config.include_variants)]
        for p in self.searched:
            for g in p.index(config.ignorecase)[0]:
                self.by_gram[g].append(p)
        self.codes = np.unique(self._codes(list(self.by_gram)))
        # Which phrases have which of the model's skipgrams, as places in self.codes.
        self.places = {p.text: np.searchsorted(self.codes, np.unique(self._codes(list(p.index(config.ignorecase)[0])))) for p in self.searched}
        n = config.ngram_size
        self.names = ["".join(chr(int(x) >> 21 * (n - 1 - i) & 0x1FFFFF) for i in range(n)) for x in self.codes]
        self.groups: dict[str, list[Phrase]] = defaultdict(list)
        for p in self.searched:
            self.groups[self.mains[p.text]].append(p)
        own = {p.text: Counter(scalar.ngrams(p.text.lower() if config.ignorecase else p.text, n)) for p in self.searched}
        self.ngrams: set[str] = set().union(*own.values())
        self.ngram_codes = np.unique(self._codes(list(self.ngrams)))
        self.ngram_places = {s: np.searchsorted(self.ngram_codes, self._codes(list(x))) for s, x in own.items()}
        self.ngram_freq = {s: np.array([k for g, k in x.items() if len(g) == n], np.int32) for s, x in own.items()}
        self.needed = {p.text: self._needed(p) for p in self.searched}
        self._tables()

    # --- exact ---

    def _main(self, text: str, variants: bool) -> str | None:
        if text in self.model.phrases:
            return text
        return self.mains.get(text) if variants else None

    def exact(self, text: str) -> list[Match]:
        """Exact occurrences of phrases (and variants, if configured); case always counts."""
        variants, out = self.config.include_variants, []
        if self.config.use_word_boundaries:
            for w in WORDS.finditer(text):
                for p, lead in self.first_words.get(w[0], ()):
                    at = w.start() - lead
                    end = at + len(p)
                    if at < 0 or text[at:end] != p or (at > 0 and is_word(text[at - 1])):
                        continue
                    if end < len(text) - 1 and is_word(text[end]):  # the text's last character isn't looked at
                        continue
                    if (main := self._main(p, variants)) is not None:
                        out.append(self._exact_match(main, p, at))
            return out
        for main, p in self.model.entries(variants):
            out += [self._exact_match(main, p.text, m.start()) for m in re.finditer(re.escape(p.text), text)]
        return out

    def _exact_match(self, main: str, variant: str, at: int) -> Match:
        return Match(main, variant, variant, at, at + len(variant), self.model.phrases[main].labels, 1.0, 1.0, 1.0, 1.0, True)

    @staticmethod
    def known_words(exact: list[Match]) -> dict[int, tuple[str, int, set[str]]]:
        """Words of exact matches by start: (word, end, matched strings). A word repeated in a match counts at its first place."""
        out: dict[int, tuple[str, int, set[str]]] = {}
        for m in exact:
            at = 0
            for w in re.split(r"\W+", m.string):
                at += m.string[at:].index(w)
                start = m.offset + at
                out.setdefault(start, (w, start + len(w), set()))[2].add(m.string)
        return out

    # --- skipgrams ---

    def _codes(self, grams: list[str]) -> np.ndarray:
        """Skipgrams of the configured size as integers, 21 bits a character; for sizes up to 3."""
        n = self.config.ngram_size
        if n > 3:
            return np.zeros(0, np.uint64)
        return np.array([sum(ord(c) << 21 * (n - 1 - i) for i, c in enumerate(g)) for g in grams if len(g) == n], np.uint64)

    def _tables(self) -> None:
        """Places of skipgrams, and of n-grams, by their characters' numbers in the model's alphabet: one array look-up a skipgram.

        Only where the alphabet is small enough for such arrays; else places are searched for.
        """
        n = self.config.ngram_size
        self.alphabet = self.table = self.ngram_table = None
        chars = sorted({c for g in (*self.by_gram, *self.ngrams) if len(g) == n for c in g})
        if not 2 <= n <= 3 or not chars or (len(chars) + 1) ** n > TABLE:
            return
        self.alphabet = np.zeros(0x110000, np.int32)
        self.alphabet[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.table, self.ngram_table = (self._table(codes, len(chars) + 1) for codes in (self.codes, self.ngram_codes))

    def _table(self, codes: np.ndarray, k: int) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        for i in range(self.config.ngram_size - 1, -1, -1):
            at = at * k + self.alphabet[(codes >> np.uint64(21 * i) & np.uint64(0x1FFFFF)).astype(np.int64)]
        out = np.full(k**self.config.ngram_size, len(codes), np.int32)
        out[at] = np.arange(len(codes))
        return out

    def _looked_up(self, chars: np.ndarray, pick: tuple[int, ...], codes: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        """The place in codes of the skipgram at every place of the text where it fits; len(codes) for those that aren't in it."""
        last = max(len(chars) - pick[-1], 0)
        if table is not None:
            k, code = round(len(table) ** (1 / self.config.ngram_size)), chars[:last]
            for p in pick:
                code = code * k + chars[p : p + last]
            return table[code]
        if not len(codes):
            return np.zeros(last, np.int64)
        code = chars[:last]
        for p in pick:
            code = code << np.uint64(21) | chars[p : p + last]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, at, len(codes))

    def _chars(self, text: str) -> np.ndarray:
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return chars.astype(np.uint64) if self.alphabet is None else self.alphabet[chars]

    def _coded(self, text: str, chars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Skipgrams of the text that are in the model: their numbers in text order, and places in self.codes."""
        chars = self._chars(text) if chars is None else chars
        picks = skip_offsets(self.config.ngram_size, self.config.skip_size)
        places = np.full((len(text), len(picks)), len(self.codes), np.int64)
        for k, pick in enumerate(picks):
            found = self._looked_up(chars, pick, self.codes, self.table)
            places[: len(found), k] = found
        flat = places.ravel()
        number = np.nonzero(flat != len(self.codes))[0]
        return number, flat[number]

    def _gram(self, text: str, number: int) -> SkipGram:
        picks = skip_offsets(self.config.ngram_size, self.config.skip_size)
        at, k = divmod(number, len(picks))
        return SkipGram(text[at] + "".join(text[at + p] for p in picks[k]), at, len(text) - at + 1, picks[k][-1] + 1)

    def _grams(self, text: str) -> list[SkipGram]:
        """Skipgrams of the text that are in the model, in text order."""
        n = self.config.ngram_size
        if n > 3 or n == 1 or len(text) <= n:
            return [g for g in scalar.skipgrams(text, n, self.config.skip_size) if g.string in self.by_gram]
        return [self._gram(text, x) for x in self._coded(text)[0].tolist()]

    # --- where a match may be ---

    def _needed(self, phrase: Phrase) -> float:
        """How many of a phrase's n-grams a match holds inside, at least: those of its two padded ends aside."""
        a = phrase.text.lower() if self.config.ignorecase else phrase.text
        size = len(scalar.ngrams(a, self.config.ngram_size))
        if not size:
            return np.inf  # without n-grams nothing passes
        return next(k for k in range(size + 1) if k / size >= self.config.ngram_threshold) - 2

    def _may_be_hot(self, phrase: Phrase, present: np.ndarray) -> bool:
        """Whether any stretch of the text may be hot, see _hot(); present: which n-grams the text has."""
        need = self.needed[phrase.text]
        return need <= 0 or self.ngram_freq[phrase.text] @ present[self.ngram_places[phrase.text]] >= need

    def _held(self, phrase: Phrase, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """How many of a phrase's n-grams the stretch from each place of the text holds, where they are, and its number of places."""
        freq = np.zeros(len(self.ngram_codes) + 1, np.int32)
        freq[self.ngram_places[phrase.text]] = self.ngram_freq[phrase.text]
        freq = freq[places]
        total = np.zeros(len(places) + 1, np.int32)
        np.cumsum(freq > 0, out=total[1:])
        size = len(phrase.text) + self.config.max_length_variance + 2 * SNAP - self.config.ngram_size + 1
        ends = np.full(len(total), total[-1], np.int32)
        if size < len(total):
            ends[: len(total) - size] = total[size:]
        return ends - total, freq, size

    def _hot(self, phrase: Phrase, places: np.ndarray) -> np.ndarray | None:
        """Places of the text from which a stretch as long as any match of the phrase holds as many of its n-grams as a match
        needs to pass; None if there is none. places: those of the text's n-grams in self.ngram_codes.

        A match is a window of at most the phrase's length and variance, whose ends move outwards by two characters at most. Of an n-gram
        that repeats only as many count as the phrase has: with f of them, one at j is too many for the stretches that reach it and begin at or
        before the f-th equal one ahead of it, which is an interval.
        """
        need = self.needed[phrase.text]
        if need <= 0:
            return np.ones(len(places) + 1, bool)
        held, freq, size = self._held(phrase, places)
        if held.max() < need:
            return None
        at = np.nonzero(freq)[0]
        order = _sorted(places[at])
        kind, place, before = places[at][order], at[order], np.arange(len(at)) - freq[at][order]
        same = (before >= 0) & (kind[before] == kind)
        last, first = place[before[same]], np.maximum(place[same] - size + 1, 0)
        some = first <= last
        change = np.bincount(first[some], minlength=len(held) + 1) - np.bincount(last[some] + 1, minlength=len(held) + 1)
        hot = held - np.cumsum(change)[: len(held)] >= need
        return hot if hot.any() else None

    def _stretches(self, phrase: Phrase, starts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of a phrase's skipgrams in the text: the last one within a match's length, and whether that stretch has as
        many different ones as a match needs.

        starts: their places, ascending; kinds: which of the phrase's skipgrams each is. The stretch from gram i holds grams
        i .. last[i]; of these, repeats are the j whose previous equal gram is at i or later. Such a j counts for all i from the
        first whose stretch reaches j up to its previous gram, which is an interval, so all stretches are counted at once.
        """
        need, gap = self.config.skipgram_threshold * phrase.distinct, self.config.ngram_size + self.config.skip_size + 1
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        below = np.cumsum(np.bincount(starts))  # grams at or before each place
        last = below[np.minimum(starts + len(phrase.text) + self.config.max_length_variance - 1, len(below) - 1)] - 1
        wide = np.append(np.diff(starts) > gap, True)  # a wide gap ends every stretch
        last = np.minimum(last, np.nonzero(wide)[0][np.cumsum(wide) - wide])
        size = last - np.arange(n) + 1
        if n < max(need, 1) or size.max() < need:
            return last, np.zeros(n, bool)
        order = _sorted(kinds)
        same = kinds[order[1:]] == kinds[order[:-1]]
        later, earlier = order[1:][same], order[:-1][same]
        first = np.cumsum(np.bincount(last, minlength=n))[later - 1]
        some = first <= earlier
        change = np.bincount(first[some], minlength=n + 1) - np.bincount(earlier[some] + 1, minlength=n + 1)
        return last, size - np.cumsum(change)[:n] >= need

    def _dense(self, phrase: Phrase, starts: np.ndarray, kinds: np.ndarray) -> bool:
        return bool(self._stretches(phrase, starts, kinds)[1].any())

    def _present(self, text: str) -> list[tuple[str, list["Found"]]]:
        """By main phrase the skipgrams of the phrases that may match; no phrase of the others can pass anywhere in the text."""
        c, n = self.config, self.config.ngram_size
        low = text.lower() if c.ignorecase else text
        if n > 3 or n == 1 or len(low) <= n:
            each, seen = defaultdict(list), {}
            for g in self._grams(low):
                seen.setdefault(g.string, len(seen))
                for p in self.by_gram[g.string]:
                    each[p.text].append(g)
            names = list(seen)
            lists = ((main, [(p, each[p.text]) for p in group if p.text in each]) for main, group in self.groups.items())
            return [(main, [Found(p, np.array([g.start for g in grams]), np.array([g.length for g in grams]), np.array([seen[g.string] for g in grams]), names, None) for p, grams in rows]) for main, rows in lists if rows]
        chars = self._chars(low)
        near = self._looked_up(chars, skip_offsets(n, 0)[0], self.ngram_codes, self.ngram_table)
        known = np.zeros(len(self.ngram_codes) + 1, bool)
        known[near] = True
        known[-1] = False
        # Where lower case moves characters or depends on their neighbours, places and n-grams of text and string may differ.
        sure = not c.ignorecase or len(low) == len(text) and "Σ" not in text
        number, place = self._coded(low, chars)
        picks = skip_offsets(n, c.skip_size)
        lengths = np.array([p[-1] + 1 for p in picks])
        present = np.zeros(len(self.codes) + 1, bool)
        present[place] = True
        out, all_hot = [], np.ones(len(near) + 1, bool)
        for main, group in self.groups.items():
            group = [p for p in group if present[self.places[p.text]].sum() + (len(p.text) <= n) >= c.skipgram_threshold * p.distinct]
            hot = {p.text: all_hot if not sure else self._hot(p, near) if self._may_be_hot(p, known) else None for p in group}
            if all(x is None for x in hot.values()):
                continue
            rows = []
            for p in group:
                has = np.zeros(len(self.codes) + 1, bool)
                has[self.places[p.text]] = True
                mask = np.nonzero(has[place])[0]
                starts = number[mask] // len(picks)
                if self._dense(p, starts, place[mask]):
                    rows.append(Found(p, starts, lengths[number[mask] % len(picks)], place[mask], self.names, hot[p.text]))
            if any(f.hot is not None for f in rows):
                out.append((main, rows))
        return out

    def _allowed(self, f: "Found", words: list[tuple[int, str, int, set[str]]], size: int) -> "Found":
        """A phrase's skipgrams within its offset limits and outside of words that are known to belong to it. size: of the text."""
        p, keep = f.phrase, np.ones(len(f.starts), bool)
        variant, reach = p.text not in self.model.phrases, len(p.text) + self.config.max_length_variance
        if not variant and p.max_start > 0:
            keep &= f.starts + f.lengths <= p.max_start + reach
        if not variant and p.max_end > 0:
            ends = np.zeros(len(f.starts), int) if size <= self.config.ngram_size else size - f.starts + 1
            keep &= ends + f.lengths <= p.max_end + reach
        if words:
            own = set(WORDS.findall(p.text)) if variant else set()
            bad = np.array([variant and w[1] not in own or p.text in w[3] for w in words])
            at = np.searchsorted([w[0] for w in words], f.starts, "right") - 1  # the last known word begun, over at its end
            keep &= ~((at >= 0) & (f.starts < np.array([w[2] for w in words])[at]) & bad[at])
        return f if keep.all() else f._replace(starts=f.starts[keep], lengths=f.lengths[keep], kinds=f.kinds[keep])

    # --- candidates ---

    def _able(self, f: "Found") -> tuple[np.ndarray, np.ndarray]:
        """For each skipgram the last one within a match's length, and whether a match may begin with it: early in the phrase, with
        enough of its skipgrams behind it and far enough one that is late in it."""
        phrase, c = f.phrase, self.config
        last, dense = self._stretches(phrase, f.starts, f.kinds)
        first, early, late, _ = phrase.index(c.ignorecase)
        kinds, inverse = np.unique(f.kinds, return_inverse=True)
        names = [f.names[k] for k in kinds]
        is_early, is_late, lead = (np.array([g(x) for x in names])[inverse] for g in (early.__contains__, late.__contains__, first.__getitem__))
        latest = np.maximum.accumulate(np.where(is_late, np.arange(len(f.starts)), -1))[last]
        reach = np.maximum.accumulate(f.starts + f.lengths)[latest]  # a window ends where any gram up to its last one does
        return last, dense & is_early & (latest >= np.arange(len(f.starts))) & (reach - np.maximum(f.starts - lead, 0) >= phrase.late_threshold - c.max_length_variance)

    def _reach(self, f: "Found", able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text from and to which candidates that begin with a phrase's able skipgrams may come, ends moved to boundaries."""
        starts = f.starts[able]
        return starts - EARLY + 1 - SNAP, starts + len(f.phrase.text) + self.config.max_length_variance + SNAP

    def _relevant(self, group: list[tuple["Found", np.ndarray]]) -> list[np.ndarray]:
        """Able skipgrams without those that have nothing to do with a match that passes.

        Candidates compete only where they overlap, so a run of able stretches that overlap one another counts as a whole, and
        those runs are left out where no stretch has the n-grams that a match needs.
        """
        if any(f.hot is None and f.names is not self.names for f, _ in group):
            return [able for _, able in group]
        spans = [self._reach(f, able) for f, able in group]
        a, z = (np.concatenate([x[i] for x in spans]) for i in (0, 1))
        if not len(a):
            return [able for _, able in group]
        hot = []
        for (f, _), (x, y) in zip(group, spans):
            if f.hot is None:
                hot.append(np.zeros(len(x), bool))
                continue
            count = np.concatenate([[0], np.cumsum(f.hot)])
            hot.append(count[np.clip(y + 1, 0, len(f.hot))] > count[np.clip(x, 0, len(f.hot))])
        order = np.argsort(a, kind="stable")
        begins = np.ones(len(a), bool)
        begins[1:] = a[order][1:] > np.maximum.accumulate(z[order])[:-1]
        run = np.empty(len(a), int)
        run[order] = np.cumsum(begins) - 1
        good = np.bincount(run, np.concatenate(hot), minlength=run.max() + 1) > 0
        out, done = [], 0
        for _, able in group:
            keep, at = np.zeros(len(able), bool), np.nonzero(able)[0]
            keep[at] = good[run[done : done + len(at)]]
            done += len(at)
            out.append(keep)
        return out

    def phrase_candidates(self, f: "Found", last: np.ndarray, able: np.ndarray, text: str) -> list[Candidate]:
        """Grows windows of matching skipgrams; see Window."""
        c, out, phrase = self.config, [], f.phrase
        window = Window(phrase, c)

        def emit(check: bool) -> None:
            if not window.fits():
                return
            span = (window.start, window.end)
            if not check or not out or (out[-1].start, out[-1].end) != span:
                if cand := window.candidate(text):
                    out.append(cand)
            if window.shift() and (cand := window.candidate(text)):
                out.append(cand)

        gap, starts, names, size = c.ngram_size + c.skip_size + 1, f.starts, f.names, len(f.starts)
        late = phrase.index(c.ignorecase)[2]
        # What a window holds depends on no gram further back than a match's length, so only stretches that may be a match are
        # walked, each from a little more than that before it.
        at = np.nonzero(self._walked(able))[0]
        left = np.searchsorted(starts, starts[at] - (len(phrase.text) + c.max_length_variance + 2 * gap)).tolist()
        done, before = 0, None
        for i, j in zip(left, last[at].tolist()):
            if j < done:
                continue
            if i > done:
                window, done = Window(phrase, c), i
                before = None
            for start, kind, length in zip(starts[done : j + 1].tolist(), f.kinds[done : j + 1].tolist(), f.lengths[done : j + 1].tolist()):
                if before is not None and start - before > gap:
                    window = Window(phrase, c)
                before, name = start, names[kind]
                window.add(SkipGram(name, start, len(text) - start + 1, length))
                if name in late:  # else it doesn't fit
                    emit(True)
            done = j + 1
        if done == size:
            emit(True)
        return out

    @staticmethod
    def _walked(able: np.ndarray) -> np.ndarray:
        """Which stretches are walked; a test walks all."""
        return able

    def candidates(self, text: str, known: dict) -> list[tuple[str, Candidate]]:
        """(main phrase, candidate) after the skipgram gate, boundary snapping and removal of overlaps."""
        c, out = self.config, []
        words = sorted((at, *w) for at, w in known.items())
        for main, rows in self._present(text):
            rows = [self._allowed(f, words, len(text)) for f in rows]
            rows = [f for f in rows if len(f.starts) and len(np.unique(f.kinds)) / f.phrase.distinct >= c.skipgram_threshold]
            able = [self._able(f) for f in rows]
            keep = self._relevant([(f, x[1]) for f, x in zip(rows, able)]) if rows else []
            cands = [x for f, (last, _), walk in zip(rows, able, keep) for x in self.phrase_candidates(f, last, walk, text)]
            if c.use_word_boundaries:
                moved = []
                for x in cands:
                    if span := snap(x.phrase.text, x.string, text, x.start, x.end, c.punctuation):
                        moved.append(x._replace(start=span[0], end=span[1], string=text[span[0] : span[1]]))
                cands = moved
            out += [(main, x) for x in best_of_overlapping(cands)]
        return out

    # --- matches ---

    def scored(self, main: str, x: Candidate) -> Match:
        c = self.config
        a, b = (x.phrase.text.lower(), x.string.lower()) if c.ignorecase else (x.phrase.text, x.string)
        char, grams = scalar.char_overlap_ratio(a, b), scalar.ngram_overlap_ratio(a, b, c.ngram_size)
        return Match(main, x.phrase.text, x.string, x.start, x.start + len(x.string), self.model.phrases[main].labels, char, grams, x.overlap, indel_ratio(a, b), False)

    def passes(self, m: Match) -> bool:
        c = self.config
        return m.char_match is not None and m.ngram_match is not None and m.char_match >= c.char_match_threshold and m.ngram_match >= c.ngram_threshold and m.levenshtein_similarity >= c.levenshtein_threshold

    def distracted(self, m: Match) -> bool:
        """Whether a distractor of the phrase is closer to the string than the phrase."""
        fold = str.lower if self.config.ignorecase else str
        return any(indel_ratio(fold(d), fold(m.string)) > m.levenshtein_similarity for d in self.model.distractors.get(m.phrase, ()))

    def search(self, text: str) -> list[Match]:
        """All matches of a text, by offset, end, phrase and variant."""
        c = self.config
        exact = [] if c.skip_exact_matching else self.exact(text)
        found = [self.scored(main, x) for main, x in self.candidates(text, self.known_words(exact))]
        found = [m for m in found if self.passes(m)]
        if c.filter_distractors:
            found = [m for m in found if not self.distracted(m)]
        taken = {(m.offset, m.phrase) for m in exact}
        found = exact + [m for m in found if (m.offset, m.phrase) not in taken]
        found = [m for m in found if (most := self.model.phrases[m.phrase].max_start) < 0 or m.offset <= most]
        if not c.allow_overlapping_matches:
            found = best_of_same_span(found, c.first_best)
        return sorted(found, key=lambda m: (m.offset, m.end, m.phrase, m.variant, not m.is_exact))


def _sorted(kinds: np.ndarray) -> np.ndarray:
    """Order of small integers, equal ones as they come; those of 16 bits sort by radix."""
    return np.argsort(kinds.astype(np.uint16) if len(kinds) and kinds.max() < 1 << 16 else kinds, kind="stable")


def is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


class Window:
    """Skipgrams of a text that may form one occurrence of a phrase. The end never moves back when front grams leave."""

    def __init__(self, phrase: Phrase, config: SearchConfig):
        self.phrase, self.config = phrase, config
        self.first, self.early, self.late, self.freq = phrase.index(config.ignorecase)
        self.grams: list[SkipGram] = []
        self.head = 0  # grams before it have left
        self.count: dict[str, int] = {}
        self.start: int | None = -1
        self.end = -1
        self.most = len(phrase.text) + config.max_length_variance

    def __len__(self) -> int:
        return len(self.grams) - self.head

    def _span(self) -> int:
        return 0 if self.start is None else self.end - self.start

    def _place(self) -> int | None:
        if not len(self):
            return None
        g = self.grams[self.head]
        return max(0, g.start - self.first[g.string])

    def _pop(self) -> None:
        s = self.grams[self.head].string
        self.head += 1
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]

    def add(self, g: SkipGram) -> None:
        grams, count, early = self.grams, self.count, self.early
        if self.head == len(grams):
            if g.string not in early:
                return
            if self.start is None or self.start < 0:
                self.start = max(0, g.start - self.first[g.string])
        grams.append(g)
        end = g.start + g.length
        if end > self.end:
            self.end = end
        count[g.string] = count.get(g.string, 0) + 1
        while self.head < len(grams) and self.start is not None and self.end - self.start > self.most:
            self._pop()
            self.start = self._place()
        while self.head < len(grams) and grams[self.head].string not in early:
            self._pop()
            self.start = self._place()

    def fits(self) -> bool:
        if not len(self) or self.grams[self.head].string not in self.early or self.grams[-1].string not in self.late:
            return False
        slack, span = self.config.max_length_variance, self._span()
        return self.phrase.late_threshold - slack <= span <= len(self.phrase.text) + slack and len(self.count) / self.phrase.distinct >= self.config.skipgram_threshold

    def shift(self) -> bool:
        """Moves the start to a later gram that is as early in the phrase, if the span is longer than the phrase."""
        extra = self._span() - len(self.phrase.text)
        if extra <= 0:
            return False
        front = self.grams[self.head]
        best, place, index = front, self.first[front.string], 0
        for i, g in enumerate(self.grams[self.head :]):
            if g.start - front.start > extra:
                break
            if g.start > best.start and self.first[g.string] <= place:
                best, place, index = g, self.first[g.string], i
            if g.string not in self.early:
                break
        for _ in range(index):
            self._pop()
        self.start = self._place()
        return index > 0

    def candidate(self, text: str) -> Candidate | None:
        if self.start is None or self.start >= self.end:
            return None
        off = sum(abs(n - self.freq[s]) for s, n in self.count.items())
        total = sum(self.count.values())
        return Candidate(self.phrase, self.start, self.end, text[self.start : self.end], (total - off) / len(self.phrase.skipgrams))


def best_of_overlapping(cands: list[Candidate]) -> list[Candidate]:
    """Of each run of overlapping candidates the closest, then the longest; each is compared with the run's best so far."""
    if len(cands) < 2:
        return cands
    cands = sorted(cands, key=lambda x: (x.start, x.end, x.phrase.text))
    score = lambda x: indel_ratio(x.phrase.text, x.string)
    out, best, top = [], cands[0], score(cands[0])
    for x in cands[1:]:
        if x.end <= best.start:
            continue
        s = score(x)
        if x.start >= best.end:
            out.append(best)
            best, top = x, s
        elif (s, len(x.string)) > (top, len(best.string)):
            best, top = x, s
    return [*out, best]


def best_of_same_span(matches: list[Match], first_best: bool = False) -> list[Match]:
    """Of matches with the same span those of highest similarity, or the first of them."""
    groups: dict[tuple[int, int], list[Match]] = defaultdict(list)
    for m in matches:
        groups[m.offset, len(m.string)].append(m)
    out = []
    for g in groups.values():
        top = max(m.levenshtein_similarity for m in g)
        best = sorted((m for m in g if m.levenshtein_similarity == top), key=lambda m: (m.phrase, m.variant))
        out += best[:1] if first_best else best
    return out


__all__ = ["Candidate", "Match", "Searcher", "Window", "best_of_overlapping", "best_of_same_span"]
