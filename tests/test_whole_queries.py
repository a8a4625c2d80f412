"""Queries that go over whole tables and texts and have no SQL, against plain Python."""

from collections import defaultdict

import pytest

from marginalia import queries as own
from marginalia.functions import scalar
from marginalia.functions.scalar import close_distance, levenshtein
from marginalia.operators import boundaries, matching
from marginalia.operators.phrase_search import MATCH_FIELDS
from marginalia.plans.config import phrase_config
from marginalia.plans.model import PhraseModel


def test_near_keywords_of_rare_words(spark, tmp_path):
    texts = ["the harbour master, the harbor mäster", "the harbour and a lighthouse", "lighthouses lighthuose harbours q qq masters", "Überfahrt überfahrten", "", "ab abc abd abcd abce", "港口 港口城 港口城市 港口城市区 港口城市群", "abcdefg abcdefh abcdxyh bcdefgh abcdef"]
    spark.createDataFrame([(i, "user", t) for i, t in enumerate(texts)], "id long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    words = sorted({w for t in texts for w in t.lower().replace(",", "").split()})
    want = {(a, b, levenshtein(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if close_distance(a, b, 3, 0.3)}
    got = own.near_keywords(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("harbor", "harbour", 1) in want and ("lighthouse", "lighthouses", 1) in want and ("港口城市", "港口城市区", 1) in want


class Plain:
    """Phrase search step by step: every skipgram of a text, every window of a phrase's skipgrams, no pruning, no numpy."""

    def __init__(self, phrases, **config):
        self.model, self.c = PhraseModel(phrases), phrase_config(config)

    def exact(self, text):
        out = []
        for main, p in self.model.entries(self.c.include_variants):
            word = lambda i: 0 <= i < len(text) and (text[i] == "_" or text[i].isalnum())
            a = next(i for i, c in enumerate(p.text) if c == "_" or c.isalnum())
            z = next((i for i in range(a, len(p.text)) if not (p.text[i] == "_" or p.text[i].isalnum())), len(p.text))
            at = text.find(p.text)
            while at >= 0:
                end = at + len(p.text)
                whole = not word(at + a - 1) and not word(at + z) and not word(at - 1) and not (end < len(text) - 1 and word(end))
                if whole or not self.c.use_word_boundaries:
                    out.append((main, p.text, at, end))
                at = text.find(p.text, at + (1 if self.c.use_word_boundaries else len(p.text)))  # without boundaries they don't overlap
        return out

    def windows(self, p, grams):
        """Spans of runs of the phrase's skipgrams that start early and end late in it, with the counts they hold."""
        n, slack = len(p.text), self.c.max_length_variance
        first, early, late, freq = p.index(False)
        held, start, end, out = [], -1, -1, []

        def place():
            return max(0, held[0].start - first[held[0].string]) if held else None

        def emit(check):
            nonlocal start, held
            if not held or held[0].string not in early or held[-1].string not in late or start is None:
                return
            if not (p.late_threshold - slack <= end - start <= n + slack and len({g.string for g in held}) / p.distinct >= self.c.skipgram_threshold):
                return
            if not check or not out or out[-1][:2] != (start, end):
                out.append((start, end, list(held)))
            extra, best, spot, index = end - start - n, held[0], first[held[0].string], 0
            if extra > 0:
                for i, g in enumerate(held):
                    if g.start - held[0].start > extra:
                        break
                    if g.start > best.start and first[g.string] <= spot:
                        best, spot, index = g, first[g.string], i
                    if g.string not in early:
                        break
                if index:
                    held = held[index:]
                    start = place()
                    out.append((start, end, list(held)))

        last = None
        for g in grams:
            if last is not None and g.start - last.start > self.c.ngram_size + self.c.skip_size + 1:
                held, start, end = [], -1, -1
            last = g
            if not held:
                if g.string not in early:
                    continue
                if start is None or start < 0:
                    start = max(0, g.start - first[g.string])
            held.append(g)
            end = max(end, g.start + g.length)
            while held and start is not None and end - start > n + slack:
                held.pop(0)
                start = place()
            while held and held[0].string not in early:
                held.pop(0)
                start = place()
            emit(True)
        emit(True)
        return [(a, z, x) for a, z, x in out if a is not None and a < z]

    def search(self, text):
        c, exact = self.c, [] if self.c.skip_exact_matching else self.exact(text)
        known = matching.Searcher.known_words([matching.Match(m, v, v, a, z, [], 1, 1, 1, 1, True) for m, v, a, z in exact])
        by_main, grams = defaultdict(list), list(scalar.skipgrams(text, c.ngram_size, c.skip_size))
        for main, p in self.model.entries(c.include_variants):
            own, variant = [], p.text not in self.model.phrases
            words = set(matching.WORDS.findall(p.text))
            for g in grams:
                if not p.has_skipgram(g.string):
                    continue
                begun = [at for at in known if at <= g.start]
                word = known[max(begun)] if begun else None
                if word and g.start >= word[1]:
                    word = None
                size = len(p.text) + c.max_length_variance
                if variant:
                    if word and word[0] not in words:
                        continue
                elif (p.max_start > 0 and p.max_start + size < g.start + g.length) or (p.max_end > 0 and p.max_end + size < g.end_offset + g.length):
                    continue
                if not (word and p.text in word[2]):
                    own.append(g)
            if len({g.string for g in own}) / p.distinct < c.skipgram_threshold:
                continue
            for a, z, held in self.windows(p, own):
                freq = p.index(False)[3]
                count = {s: sum(g.string == s for g in held) for s in {g.string for g in held}}
                overlap = (len(held) - sum(abs(k - freq[s]) for s, k in count.items())) / len(p.skipgrams)
                by_main[main].append(matching.Candidate(p, a, z, text[a:z], overlap))
        out = {(m, v, text[a:z], a, z, 1.0, True) for m, v, a, z in exact}
        for main, cands in by_main.items():
            if c.use_word_boundaries:
                spans = [(x, boundaries.snap(x.phrase.text, x.string, text, x.start, x.end, c.punctuation)) for x in cands]
                cands = [x._replace(start=s[0], end=s[1], string=text[s[0] : s[1]]) for x, s in spans if s]
            for x in matching.best_of_overlapping(cands):
                ratios = scalar.char_overlap_ratio(x.phrase.text, x.string), scalar.ngram_overlap_ratio(x.phrase.text, x.string, c.ngram_size), scalar.indel_ratio(x.phrase.text, x.string)
                if None in ratios or any(r < t for r, t in zip(ratios, (c.char_match_threshold, c.ngram_threshold, c.levenshtein_threshold))):
                    continue
                if c.filter_distractors and any(scalar.indel_ratio(d, x.string) > ratios[2] for d in self.model.distractors.get(main, ())):
                    continue
                if not any(e[0] == main and e[2] == x.start for e in exact):
                    out.add((main, x.phrase.text, x.string, x.start, x.start + len(x.string), round(ratios[2], 9), False))
        out = {m for m in out if (most := self.model.phrases[m[0]].max_start) < 0 or m[3] <= most}
        if not c.allow_overlapping_matches:
            best = defaultdict(float)
            for m in out:
                best[m[3], len(m[2])] = max(best[m[3], len(m[2])], m[5])
            out = {m for m in out if m[5] == best[m[3], len(m[2])]}
        return out


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def found(df):
    return {(r.doc_id, r.phrase, r.variant, r.string, r.offset, r.end, round(r.levenshtein_similarity, 9), r.is_exact) for r in df.collect()}


def plain(docs, phrases, **config):
    p = Plain(phrases, **config)
    return {(i, *m) for i, t in docs.items() if t for m in p.search(t)}


def test_fuzzy_phrases_of_every_document(spark, sf_dir):
    got, docs = found(own.fuzzy_phrases(spark, sf_dir)), texts_of(spark, sf_dir)
    assert got == plain(docs, own.MODEL, include_variants=True, filter_distractors=True) and any(not m[-1] for m in got)


def test_fuzzy_contexts_of_every_document(spark, sf_dir):
    df, docs = own.fuzzy_contexts(spark, sf_dir), texts_of(spark, sf_dir)
    assert found(df) == plain(docs, own.MODEL, context_size=40, allow_overlapping_matches=True)
    for r in df.collect():
        t = docs[r.doc_id]
        assert (r.context_start, r.context_end) == (max(r.offset - 40, 0), min(r.end + 40, len(t))) and r.context == t[r.context_start : r.context_end]
        assert r.prefix + t[r.offset : r.end] + r.suffix == r.context


def test_fuzzy_passages_of_every_document(spark, sf_dir):
    docs = texts_of(spark, sf_dir)
    items = {r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text}
    got = found(own.fuzzy_passages(spark, sf_dir))
    some = {i: docs[i] for i in sorted({m[0] for m in got})[:4] + sorted(docs)[:4]}
    config = {"levenshtein_threshold": 0.8, "ngram_threshold": 0.7, "char_match_threshold": 0.8, "skipgram_threshold": 0.8, "max_length_variance": 3}
    assert {m for m in got if m[0] in some} == plain(some, sorted(items), **config)


def test_combined_matches_of_every_document(spark, sf_dir):
    docs, want = texts_of(spark, sf_dir), set()
    fuzzy, exact = Plain(own.MODEL, include_variants=True, skip_exact_matching=True, allow_overlapping_matches=True), Plain(own.MODEL, include_variants=True)
    for i, t in docs.items():
        e = {(m, v, t[a:z], a, z, 1.0, True) for m, v, a, z in exact.exact(t)}
        both = e | {m for m in fuzzy.search(t) if (m[0], m[3]) not in {(x[0], x[3]) for x in e}}
        want |= {(i, m[0], m[1], m[3], m[4], round(m[5], 6), m[6]) for m in both if m[5] == max(x[5] for x in both if (x[3], len(x[2])) == (m[3], len(m[2])))}
    rows = own.combined_matches(spark, sf_dir).collect()
    assert {(r.doc_id, r.phrase, r.variant, r.offset, r.end, r.score, r.is_exact) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("config", [{}, {"max_length_variance": 3, "skipgram_threshold": 0.4}, {"use_word_boundaries": False, "skipgram_threshold": 0.5}, {"include_variants": True, "levenshtein_threshold": 0.7}])
def test_misspelt_texts(config):
    import random

    rng = random.Random(3)
    phrases = [{"phrase": "harbour master of the town", "variants": ["master of the harbour"]}, "old windmill", {"phrase": "opening words", "max_start_offset": 30}, {"phrase": "closing words", "max_end_offset": 30}, "the the"]
    words = "the harbour master of town old windmill opening words closing and so then again".split()
    searcher, p = matching.Searcher(PhraseModel(phrases), phrase_config(config)), Plain(phrases, **config)
    for _ in range(60):
        t = list(" ".join(rng.choices(words, k=40)))
        for _ in range(rng.randint(0, 25)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "e", "rr", " "])
        text = "".join(t)
        assert {(m.phrase, m.variant, m.string, m.offset, m.end, round(m.levenshtein_similarity, 9), m.is_exact) for m in searcher.search(text)} == p.search(text), text


def test_phrase_tables_in_slices(spark, sf_dir):
    from marginalia.operators import phrase_search as ps

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.createDataFrame([(x,) for x in [*own.PHRASES, *own.PHRASES, None, ""]], "phrase string")
    search = lambda d, m: ps.exact_matches(d, m)
    whole, sliced = ps.search_slices(docs, items, search), ps.search_slices(docs, items, search, most=3)
    assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect())) and whole.count() > 0
    assert MATCH_FIELDS.split()[0] in whole.columns and "BroadcastNestedLoopJoin" not in whole._jdf.queryExecution().toString()
    assert ps.search_slices(docs, items.where("phrase is null"), search).count() == 0
