"""Templates: trees of label and group elements that labelled matches may fit, in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from marginalia.plans.model import PhraseModel

CARDINALITIES = ("single", "multi")


@dataclass
class Element:
    label: str | None
    required: bool = False
    #: Read and checked, but not enforced by matching, as are the other properties of labels.
    cardinality: str = "single"
    variable: bool = False
    next_label: str | None = None
    next_distance_max: int | None = None
    elements: list["Element"] | None = None  # of a group
    ordered: bool = True

    @property
    def is_group(self) -> bool:
        return self.elements is not None


@dataclass
class Template:
    root: Element
    name: str | None = None
    labels: dict[str, Element] = field(default_factory=dict)
    groups: dict[str, Element] = field(default_factory=dict)

    @staticmethod
    def parse(spec: list | dict, model: PhraseModel | None = None, ignore_unknown: bool = False) -> "Template":
        """From a tree of dicts, or a list of them or of labels. Labels must be known to the model, unless variable or
        ignore_unknown, which leaves them out."""
        name = spec.get("label") if isinstance(spec, dict) else None
        if isinstance(spec, list):
            spec = dict(type="group", elements=[dict(label=e, type="label") if isinstance(e, str) else e for e in spec])
        kind = spec.get("type", "group" if "elements" in spec else "label")
        if kind not in ("label", "group"):
            raise ValueError("an element is a label or a group")
        if kind == "label":
            spec = {"type": "group", "elements": [spec]}
        out = Template(Element(None), name)
        root = out._element({**spec, "type": "group"}, model, ignore_unknown)
        if root is None:
            raise ValueError("the template has no elements")
        out.root = root
        return out

    def _element(self, spec: dict, model: PhraseModel | None, ignore_unknown: bool) -> Element | None:
        kind = spec.get("type", "group" if "elements" in spec else "label")
        for key in ("required", "ordered", "variable"):
            if not isinstance(spec.get(key, False), bool):
                raise ValueError(f"{key} must be true or false")
        if kind == "group":
            inner = [e for e in (self._element({"label": s} if isinstance(s, str) else s, model, ignore_unknown) for s in spec["elements"]) if e is not None]
            out = Element(spec.get("label"), spec.get("required", False), elements=inner, ordered=spec.get("ordered", True))
            if out.label:
                self.groups[out.label] = out
            return out
        if kind != "label" or not isinstance(spec.get("label"), str):
            raise ValueError(f"not an element: {spec!r}")
        if spec.get("cardinality", "single") not in CARDINALITIES:
            raise ValueError("cardinality is single or multi")
        most = spec.get("next_distance_max")
        if most is not None and (not isinstance(most, int) or most < 0):
            raise ValueError("next_distance_max must be an integer of 0 or more")
        if model is not None and not model.is_label(spec["label"]) and not spec.get("variable"):
            if ignore_unknown:
                return None
            raise ValueError(f"no phrase has the label {spec['label']}")
        out = Element(spec["label"], spec.get("required", False), spec.get("cardinality", "single"), spec.get("variable", False), spec.get("next_label"), most)
        self.labels[out.label] = out
        return out

    def has_label(self, label: str | list[str]) -> bool:
        return any(x in self.labels for x in ([label] if isinstance(label, str) else label))

    def has_group(self, label: str) -> bool:
        return label in self.groups

    def get_element(self, label: str) -> Element | None:
        return self.labels.get(label) or self.groups.get(label)

    def required_labels(self) -> list[str]:
        return [x for x, e in self.labels.items() if e.required]

    def by_cardinality(self, cardinality: str) -> list[str]:
        return [x for x, e in self.labels.items() if e.cardinality == cardinality]

    def label_phrases(self, label: str, model: PhraseModel) -> list[str]:
        return [p for p, x in model.phrases.items() if label in x.labels]
