import json

import pytest

from marginalia.operators import context, phrase_search, token_search
from marginalia.operators.token_matching import FULL, PART_OF_PHRASE_TOKEN, PART_OF_TEXT_TOKEN, TokenSearcher, tokens_of
from marginalia.plans.config import token_config
from marginalia.plans.model import PhraseModel
from marginalia.sources import matches as io


def find(text, phrases, vocabulary=None, **config):
    return TokenSearcher(PhraseModel(phrases), token_config(config), vocabulary).search(text)


def test_plain_and_misspelt():
    assert [(m.phrase, m.offset, m.levenshtein_similarity) for m in find("An old ferry house.", ["ferry house"])] == [("ferry house", 7, 1.0)]
    assert [m.string for m in find("an old fery hause", ["ferry house"])] == ["fery hause"]
    assert find("nothing alike", ["ferry house"]) == []


def test_split_and_joined_words():
    assert [m.string for m in find("the light house stood", ["lighthouse"], max_length_variance=2)] == ["light house"]
    kinds = dict(TokenSearcher(PhraseModel(["lighthouse"]), token_config()).kinds("light"))
    assert kinds == {"lighthouse": PART_OF_PHRASE_TOKEN}
    s = TokenSearcher(PhraseModel(["light"]), token_config())
    assert dict(s.kinds("lighthouse")) == {"light": PART_OF_TEXT_TOKEN} and dict(s.kinds("lights")) == {"light": FULL}


def test_best_phrase_per_start_and_distractors():
    assert [m.phrase for m in find("the ferry housse", ["ferry house", "ferry horse"])] == ["ferry house"]
    model = [{"phrase": "ferry house", "distractors": ["ferry horse"]}]
    assert find("the ferry horse", model) == [] and find("the ferry house", model)
    assert [(m.phrase, m.variant) for m in find("the boat house", [{"phrase": "ferry house", "variants": ["boat house"]}])] == [("ferry house", "boat house")]


def test_vocabulary_rules_tokens_out():
    assert find("in the mourning", ["morning"]) and TokenSearcher(PhraseModel(["testing"]), token_config(), ["resting"]).match_pairs == {("resting", "testing")}
    s = TokenSearcher(PhraseModel(["stone"]), token_config(), ["throne", "one"])
    assert (("one",), "stone") not in s.distractor_pairs
    s.add_distractor_pair(("stine",), "stone")
    assert s.search("a stine") == []


def test_offsets_limit_tokens():
    model = [{"phrase": "dear sir", "max_start_offset": 4}]
    assert find("dear sir, and then", model) and find("then I wrote dear sir", model) == []


def test_long_repetitive_text_stays_small():
    text = "ferry house " * 300
    assert len(find(text, ["ferry house"])) == 300


def docs(spark):
    return io.documents(spark, [{"id": "d1", "text": "We met at the harbour mastr of the town, and the harbour master smiled."}, "no id here", ("x", "harbour master")])


def test_token_search_over_documents(spark):
    out = token_search.search_tokens(docs(spark), PhraseModel(["harbour master"])).collect()
    assert {(r.doc_id, r.offset) for r in out} == {("d1", 14), ("d1", 49), ("x", 0)}


def test_token_pairs(spark):
    terms = spark.createDataFrame([("resting",), ("ring",), ("xyz",)], "term string")
    tokens = spark.createDataFrame([("testing",)], "token string")
    got = {r.term: r.is_distractor for r in token_search.token_pairs(terms, tokens).collect()}
    assert got["resting"] is False and "xyz" not in got


def test_context_and_search_within(spark):
    d = docs(spark)
    ctx = context.search_context(d, PhraseModel(["harbour master"]), {"context_size": 12})
    rows = {(r.doc_id, r.offset): r for r in ctx.collect()}
    r = rows["d1", 49]
    text = d.where("doc_id = 'd1'").first().text
    assert (r.context, r.prefix, r.suffix) == (text[37:71][: r.context_end - 37], text[37:49], text[63:71]) and r.context_start == 37
    assert rows["x", 0].context == "harbour master" and rows["x", 0].prefix == ""
    inner = context.search_within(ctx, PhraseModel(["town", "smiled"])).collect()
    assert all(text[m.offset : m.end] == m.string for m in inner) and {m.string for m in inner} >= {"smiled"}
    with pytest.raises(ValueError):
        context.add_context(ctx, d, -1)


def test_json_round_trip_and_annotations(spark):
    d = docs(spark)
    m = phrase_search.search_phrases(d, PhraseModel([{"phrase": "harbour master", "label": ["office", "person"]}]))
    back = io.from_json(io.to_json(m))
    key = lambda rows: sorted((r.doc_id, r.offset, r.string, tuple(r.labels), r.levenshtein_similarity) for r in rows.collect())
    assert key(back) == key(m)
    notes = [json.loads(r.annotation) for r in io.to_web_annotations(m).collect()]
    kinds = {tuple(b["purpose"] for b in n["body"]) for n in notes}
    assert kinds == {("tagging", "highlighting", "classifying"), ("tagging", "highlighting", "correcting", "classifying")}
    ctx = context.add_context(m, d, 5, 5)
    note = json.loads(io.to_web_annotations(ctx).first().annotation)
    assert [s["type"] for s in note["target"]["selector"]] == ["TextPositionSelector", "TextQuoteSelector"]
    assert io.from_json(io.to_json(ctx)).where("context is null").count() == 0


def test_documents_and_model_files(spark, tmp_path):
    with pytest.raises(TypeError):
        io.documents(spark, [3])
    model = PhraseModel([{"phrase": "é", "variants": ["e"]}])
    io.write_model(model, str(tmp_path / "m.json"))
    assert io.read_model(str(tmp_path / "m.json")).json() == model.json()


def test_tokens_like_no_phrase_cost_nothing_further():
    """Only tokens that may stand for one of a phrase are built; whole texts give what all of their tokens give, and chains keep their ends."""
    s = TokenSearcher(PhraseModel(["harbour master", {"phrase": "ferry house", "distractors": ["ferry horse"]}]), token_config())
    text = "xyzzy, the harbor mastre; qwkv zzj (ferry hause) " * 40
    likely, every = s.likely_tokens(text), tokens_of(text)
    assert likely == [t for t in every if s.kinds(t.n)] and len(likely) < len(every) / 2
    assert s.token_matches(likely) == s.token_matches(every)
    found = s.search(text)
    assert len(found) == 80 and all(text[m.offset : m.end] == m.string for m in found)
    for chains in s.chains(s.token_matches(likely)).values():
        assert all(c.end == c.tokens[-1].end and c.start == c.tokens[0].at for c in chains)
    folded = TokenSearcher(PhraseModel(["harbour master"]), token_config({"ignorecase": True}))
    assert folded.likely_tokens("İ HARBOUR, Master") == tokens_of("İ HARBOUR, Master", True)[1:2] + tokens_of("İ HARBOUR, Master", True)[3:]
