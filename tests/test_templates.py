import pytest

from marginalia.operators import templates as t
from marginalia.plans.model import PhraseModel
from marginalia.plans.template import Template

def leaf(label, **more):
    return dict(type="label", label=label, **more)


def group(label, *elements, **more):
    return dict(type="group", label=label, elements=list(elements), **more)


HEAD = group("head", leaf("day"), leaf("seller", required=True), ordered=False)
LOTS = group("lots", leaf("good", required=True, cardinality="multi"), leaf("unit"), ordered=False, required=True)
SPEC = group("notice", HEAD, leaf("verb", required=True), LOTS, ordered=True)


def runs(labels, spec=SPEC):
    rows = [(i * 10, [x] if isinstance(x, str) else x, f"p{i}", f"s{i}") for i, x in enumerate(labels)]
    return [(r[2], r[3]) for r in t.fit(rows, Template.parse(spec))]


def test_ordered_template():
    assert runs(["seller", "day", "verb", "good", "unit", "unit"]) == [(0, 6)]
    assert runs(["day", "seller", "verb", "good"]) == [(0, 4)]
    assert runs(["seller", "day", "good", "unit"]) == []  # a required label is missing
    assert runs(["good", "seller", "verb", "good"]) == [(1, 4)]
    two = ["seller", "verb", "good", "unit"]
    assert runs(two * 2) == [(0, 4), (4, 8)]


def test_a_gap_before_a_required_element_fails():
    assert runs(["seller", "good", "verb", "good"]) == [] or all(a < b for a, b in runs(["seller", "good", "verb", "good"]))


def test_unordered_and_lists():
    spec = group(None, leaf("a"), leaf("b"), ordered=False)
    assert runs(["b", "a", "x", "a"], spec) == [(0, 3)]  # x has no place in the template, so it isn't between them
    assert runs(["a", "b", "c"], ["a", "b", "c"]) == [(0, 3)] and runs([["a", "b"], "c"], ["a", "b", "c"]) == [(0, 2)]
    assert runs([], ["a"]) == [] and runs(["x"], ["a"]) == []


def test_elements_and_groups():
    rows = [(0, ["day"], "p", "s"), (5, ["seller"], "q", "r"), (9, ["verb"], "v", "v"), (12, ["good"], "g", "g")]
    elements = t.fit(rows, Template.parse(SPEC))[0][4]
    assert [(e["label"], e["label_groups"], e["offsets"]) for e in elements] == [("day", ["notice", "head"], [0]), ("seller", ["notice", "head"], [5]), ("verb", ["notice"], [9]), ("good", ["notice", "lots"], [12])]


def test_parsing():
    model = PhraseModel([{"phrase": "x", "label": "a"}])
    with pytest.raises(ValueError):
        Template.parse(["a", "b"], model)
    some = Template.parse(["a", "b"], model, ignore_unknown=True)
    assert list(some.labels) == ["a"] and some.label_phrases("a", model) == ["x"]
    assert Template.parse([{"label": "b", "variable": True}], model).has_label("b")
    for bad in ({"type": "other"}, [{"label": "a", "cardinality": "many"}], [{"label": "a", "required": 1}], [{"label": "a", "next_distance_max": -1}]):
        with pytest.raises(ValueError):
            Template.parse(bad)
    full = Template.parse(SPEC)
    assert full.required_labels() == ["seller", "verb", "good"] and full.by_cardinality("multi") == ["good"] and full.has_group("lots") and full.get_element("lots").required


def test_over_documents_and_tables(spark):
    model = PhraseModel([{"phrase": "farmer Jansen", "label": "seller"}, {"phrase": "will sell", "label": "verb"}, {"phrase": "ten cows", "label": "good"}, {"phrase": "on Monday", "label": "day"}])
    docs = spark.createDataFrame([(1, "on Monday farmer Janssen will sell ten cows"), (2, "farmer Jansen bought ten cows"), (3, None)], "doc_id int, text string")
    spec = group("notice", HEAD, leaf("verb", required=True), leaf("good", required=True))
    template = Template.parse(spec, model)
    out = t.search_templates(docs, template, model).collect()
    assert [(r.doc_id, r.start_idx, r.end_idx, r.template) for r in out] == [(1, 0, 4, "notice")]
    from marginalia.operators.phrase_search import search_phrases

    again = t.fit_templates(search_phrases(docs, model, {"allow_overlapping_matches": True}), template).collect()
    assert out == again
