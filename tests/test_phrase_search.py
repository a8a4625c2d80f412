import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.scalar import skipgrams
from marginalia.operators import phrase_search as ps
from marginalia.operators.boundaries import end_shift, snap_start
from marginalia.operators import matching
from marginalia.operators.matching import Searcher
from marginalia.plans.config import phrase_config
from marginalia.plans.model import PhraseModel


def find(text, phrases, **config):
    return Searcher(PhraseModel(phrases), phrase_config(config)).search(text)


def test_typo_is_found():
    m = find("We found a harbor mastr at the quay.", ["harbor master"])
    assert [(x.phrase, x.string, x.offset, x.is_exact) for x in m] == [("harbor master", "harbor mastr", 11, False)]
    assert m[0].levenshtein_similarity == pytest.approx(24 / 25)


def test_exact_and_near_together():
    m = find("old windmill, and an old windnill", ["old windmill"])
    assert [(x.string, x.is_exact) for x in m] == [("old windmill", True), ("old windnill", False)]


def test_repeated_and_prefixed_words():
    assert [x.offset for x in find("garden garden gardem", ["garden"])] == [0, 7, 14]
    assert find("the undergarden", ["garden"]) == []


def test_variants_and_distractors():
    model = [{"phrase": "the lantern", "variants": ["a lantern lit"], "distractors": ["the lectern"]}]
    m = find("near a lantern lit we stood", model, include_variants=True)
    assert ("the lantern", "a lantern lit", True) in [(x.phrase, x.variant, x.is_exact) for x in m]
    assert find("by the lectern today", model) and not find("by the lectern today", model, filter_distractors=True)


def test_limits_and_case():
    model = [{"phrase": "opening words", "max_start_offset": 5}]
    assert len(find("opening words and more opening words", model)) == 1
    assert find("OPENING WORDZ", ["opening words"]) == [] and len(find("OPENING WORDZ", ["opening words"], ignorecase=True)) == 1
    ends = [{"phrase": "closing words", "max_end_offset": 3}]
    assert find("some text with the closing wordz", ends)


def test_same_span_keeps_the_best():
    assert {m.phrase for m in find("winter roze", ["winter rose", "winter rote"])} == {"winter rose", "winter rote"}
    assert len(find("winter roze", ["winter rose", "winter rote"], first_best=True)) == 1


def test_bad_settings_and_phrases():
    with pytest.raises(ValueError):
        phrase_config({"nonsense": 1})
    with pytest.raises(TypeError):
        PhraseModel([{"variants": ["x"]}])
    with pytest.raises(ValueError):
        PhraseModel([{"phrase": "x", "max_start_offset": -3}])
    with pytest.raises(ValueError):
        Searcher(PhraseModel(["abc"], 3, 1), phrase_config())


def test_model_changes():
    m = PhraseModel([{"phrase": "one", "variants": ["uno"], "distractors": ["on"], "label": "n"}, "two"])
    assert m.variant_of("uno") == "one" and m.is_label("n") and m.phrases_up_to(3, True) == ["one", "two", "uno"]
    again = PhraseModel(m.json())
    assert again.json() == m.json()
    m.remove_variants(of="one")
    m.remove_distractors(of="one")
    assert m.get_variants("one") == [] and m.distractors["one"] == []
    again.remove_phrases(["one"])
    assert again.get_phrases() == ["two"] and not again.variants
    caps = PhraseModel([{"phrase": "a b", "max_start_offset": 4}, {"phrase": "b c", "max_start_offset": 9}, "c d"]).token_caps()
    assert caps == {"a": 4, "b": 9}


def test_model_tables(spark):
    m = PhraseModel([{"phrase": "harbor", "variants": ["haven"], "distractors": ["harder"]}])
    assert {(r.phrase, r.role) for r in m.table(spark).collect()} == {("harbor", "phrase"), ("haven", "variant"), ("harder", "distractor")}
    rows = [r for r in m.skipgram_table(spark).collect() if r.phrase == "harbor"]
    assert len(rows) == len({g.string for g in skipgrams("harbor")}) and sum(r.freq for r in rows) == len(list(skipgrams("harbor")))


def test_grams_of_long_texts_equal_the_plain_ones():
    rng = random.Random(5)
    for n, skip in ((2, 2), (3, 1), (2, 0), (1, 1), (4, 1)):
        model = PhraseModel(["abra cad", "bad cab"], n, skip)
        s = Searcher(model, phrase_config({"ngram_size": n, "skip_size": skip}))
        for size in (0, 1, 2, 3, 4, 50):
            text = "".join(rng.choices("abcdr é🙂", k=size))
            assert s._grams(text) == [g for g in skipgrams(text, n, skip) if g.string in s.by_gram], (n, skip, text)


def test_end_shift_is_total():
    kinds = ["".join(x) for k in range(4) for x in itertools.product("ws", repeat=k)]
    for pe, me, sx in itertools.product([k for k in kinds if k], kinds, kinds):
        shift = end_shift(pe, me, sx)
        assert shift is None or -2 <= shift <= 2
    assert end_shift("www", "www", "ws") == 1 and end_shift("www", "www", "www") is None and end_shift("sws", "wsw", "w") == -1
    assert snap_start("xab cd", "cd", 4) == 4 and snap_start("xyz", "z", 2) == 0 and snap_start("wxyz", "z", 3) is None


def brute_exact(text, phrase):
    """Occurrences whose first word is a whole word and whose end is no word character, but for the text's last."""
    out = []
    for at in range(len(text) - len(phrase) + 1):
        end = at + len(phrase)
        if text[at:end] != phrase or at and re.match(r"\w", text[at - 1]) or end < len(text) - 1 and re.match(r"\w", text[end]):
            continue
        w = re.search(r"\w+", phrase)
        if w and (m := re.compile(r"\w+").match(text, at + w.start())) and m[0] == w[0] and not (at + w.start() and re.match(r"\w", text[at + w.start() - 1])):
            out.append(at)
    return out


def test_native_exact_equals_the_searcher(spark):
    rng = random.Random(2)
    phrases = ["a b", "a b a", "(a) b", "b\\E", "é a", "aa"]
    texts = [None, "", "a b", "a b a b a", "xa b", "a bx", "a bxy", "(a) b", "b\\E a", "é aé a"] + ["".join(rng.choices("ab é(\\E)", k=30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = PhraseModel(phrases)
    for words in (True, False):
        got = {(r.doc_id, r.phrase, r.offset) for r in ps.exact_matches(docs, model, {"use_word_boundaries": words}).collect()}
        s = Searcher(model, phrase_config({"use_word_boundaries": words}))
        assert got == {(i, m.phrase, m.offset) for i, t in enumerate(texts) if t for m in s.exact(t)}
        if words:
            assert got == {(i, p, at) for i, t in enumerate(texts) if t for p in phrases for at in brute_exact(t, p)}


def test_search_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = PhraseModel(["under the MIT License", "General Public License", "rights reserved"])
    out = ps.search_phrases(docs, model, {"ignorecase": False})
    rows = out.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(texts[r.doc_id][r.offset : r.end] == r.string for r in rows)
    assert {(r.doc_id, r.offset, r.phrase) for r in ps.exact_matches(docs, model).collect()} == {(r.doc_id, r.offset, r.phrase) for r in rows if r.is_exact}


def table(spark, rows):
    return spark.createDataFrame([(d, p, p, "x" * (e - o), o, e, s) for d, p, o, e, s in rows], "doc_id int, phrase string, variant string, string string, offset int, end int, levenshtein_similarity double")


def test_set_operations(spark):
    a = table(spark, [(1, "p", 0, 5, 1.0), (1, "q", 9, 12, 1.0)])
    b = table(spark, [(1, "p", 0, 6, 0.9), (1, "p", 3, 8, 0.8), (2, "p", 0, 5, 0.7), (2, "q", 0, 5, 0.7), (2, "r", 0, 5, 0.6)])
    both = ps.combine(a, b)
    assert both.count() == 6
    assert both.transform(ps.best_of_same_span).count() == 5 and both.transform(lambda d: ps.best_of_same_span(d, True)).count() == 4
    got = {(r.left.offset, r.right.offset) for r in ps.overlapping(a, b, bucket=2).collect()}
    assert got == {(0, 0), (0, 3)}
    ranges = {(r.doc_id, r.start, r.end) for r in ps.merged_ranges(both).collect()}
    assert ranges == {(1, 0, 8), (1, 9, 12), (2, 0, 5)}
    assert ps.within_offset(both, PhraseModel([{"phrase": "p", "max_start_offset": 0}])).where(F.col("phrase") == "p").count() == 2


def test_density_against_brute_force():
    rng = random.Random(8)
    s = Searcher(PhraseModel(["abcdefgh"]), phrase_config({"skipgram_threshold": 0.3}))
    p = s.model.phrases["abcdefgh"]
    for _ in range(300):
        n = rng.randint(0, 25)
        starts = np.sort(np.array([rng.randint(0, 30) for _ in range(n)], int))
        kinds = np.array([rng.randint(0, 9) for _ in range(n)], int)
        def run(i):
            """Kinds from gram i on, up to a phrase's length and a gap of more than five."""
            out = {int(kinds[i])}
            for a, z, k in zip(starts[i:], starts[i + 1 :], kinds[i + 1 :]):
                if z - a > 5 or z >= starts[i] + 9:
                    break
                out.add(int(k))
            return out

        best = max((len(run(i)) for i in range(n)), default=0)
        assert s._dense(p, starts, kinds) == (best >= 0.3 * p.distinct and best > 0)


def test_search_equals_search_without_pruning(monkeypatch):
    rng = random.Random(9)
    words = ["harbor", "master", "harbour", "mister", "the", "of", "quay", "a"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    model = PhraseModel([{"phrase": "harbor master", "variants": ["master of the quay"], "max_start_offset": 60}, "the quay", {"phrase": "of a", "max_end_offset": 30}])
    s = Searcher(model, phrase_config({"include_variants": True}))
    pruned = [s.search(t) for t in texts]
    stretches = Searcher._stretches
    monkeypatch.setattr(Searcher, "_walked", staticmethod(np.ones_like))
    monkeypatch.setattr(Searcher, "_stretches", lambda self, p, starts, kinds: (stretches(self, p, starts, kinds)[0], np.ones(len(starts), bool)))
    assert [s.search(t) for t in texts] == pruned and sum(map(len, pruned)) > 50


def test_windows_are_walked_only_near_texts_that_may_pass(monkeypatch):
    """Prose that shares many skipgrams with a phrase but nowhere enough n-grams; a misspelt phrase in it is found as before."""
    prose = "Eaea ndorea as erthndly edst threeain for heed, thheha thatnd the thnt estion ntes a onenble lyndre thintion reed thshthble of inin in thtion erhees ntre ndingnd the with. " * 20
    walked, add = [], matching.Window.add
    monkeypatch.setattr(matching.Window, "add", lambda self, g: (walked.append(g), add(self, g))[1])
    s = Searcher(PhraseModel(["under the Apache License"]), phrase_config())
    assert not s.search(prose) and len(walked) == 0
    found = s.search(prose + "See under the Apach Licence. " + prose)
    assert [m.string for m in found] == ["under the Apach Licence"] and 0 < len(walked) < 500
