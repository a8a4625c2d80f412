import random
import re
import time

import pytest

from marginalia.llm import license_rules, licenses

SCHEMA = "doc_id long, text string, labels string, score int"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def slow_labels(text):
    """All rules without prefilter, then pairwise suppression."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    s = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    hits = [(p, -(m.end() - m.start()), m.start(), i, m.end(), label) for i, (p, label, _, r) in enumerate(license_rules.rules()) for m in re.finditer(f"(?<= )(?:{r})(?= )", s)]
    kept = []
    for h in sorted(hits):
        if all(not (k[2] <= h[2] and h[4] <= k[4]) for k in kept):
            kept.append(h)
    return {h[5] for h in kept}


def check(row, text):
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == slow(text)
    assert 0 <= row.score <= 1 and (row.score > 0) == (row.n_detections > 0)
    base = set(row.base_labels.split(",")) - {""}
    assert ",".join(sorted(base | slow_labels(text))) == row.labels


ODD = [
    None, "", " .,;", "UNDER THE MIT LICENSE", "under-the.mit/license cc by nc by nc cc BY nc", "apache license version 2.0 Apache License, Version 2", "aunder the mit license", "é under the mit license é", "under the mit licenseé", "cc by nc " * 3000, "x" * 50000,
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: LGPL-2.1-or-later", "Dual licensed under GPLv2 or the MIT license.",
    "released under the GNU Lesser General Public License v3", "Distributed under Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "\x00under\x7fthe mit license", "İ under the mit license",
]


def test_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = licenses.op2_license_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(ODD)] * 2, SCHEMA)
    rows = licenses.license_digest(df).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        check(r, ODD[r.doc_id])
    assert licenses.license_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    d = {r.doc_id: r.detections for r in licenses.scan(df).collect()}
    assert [(x.label, x.start, x.end, x.text) for x in d[3]] == [("mit", 0, 4, "under the mit license")]


def labels(text):
    return [d[2] for d in licenses.matcher().detections(licenses.normal(text.encode())[0].decode())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
        ("GNU Lesser General Public License", ["lgpl"]),
        ("under the GNU Affero General Public License v3.0 or later", ["agpl-3"]),
        ("Mozilla Public License 2.0", ["mpl-2"]),
        ("Alle Rechte vorbehalten.", ["all-rights-reserved"]),
        ("the 3-Clause BSD licence", ["bsd-3"]),
        ("see https://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa"]),
        ("he went mit dem Bus to apache county and saw a license plate", []),
    ],
)
def test_signatures(text, want):
    assert labels(text) == want


def sample(parsed, rng):
    """A string that a parsed regex matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kinds = [a for a in arg if str(a[0]) in ("LITERAL", "RANGE")]
            kind = rng.choice(kinds) if kinds else None
            out += "x" if kind is None else chr(kind[1] if str(kind[0]) == "LITERAL" else rng.randint(*kind[1]))
        elif name == "MAX_REPEAT":
            low, high, sub = arg
            out += "".join(sample(sub, rng) for _ in range(rng.randint(low, min(high, low + 3))))
        elif name == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        else:
            raise NotImplementedError(name)
    return out


def test_keywords_gate_without_loss():
    """Whatever a rule matches holds its keyword, or the prefilter would lose detections."""
    from re import _parser

    rng, rows, m = random.Random(5), license_rules.rules(), licenses.matcher()
    assert len(rows) > 250
    for _, _, keyword, regex in rows:
        for _ in range(20):
            s = " " + sample(_parser.parse(regex), rng).strip() + " "
            assert keyword in {k for _, k in m.automaton.iter(s)}, (keyword, s)


def test_intervals_against_all_pairs():
    rng = random.Random(7)
    for _ in range(300):
        seen, kept = licenses.Intervals(), []
        for _ in range(30):
            a = rng.randint(0, 40)
            z = a + rng.randint(1, 15)
            inside = any(s <= a and z <= e for s, e in kept)
            assert seen.cover(a, z) == inside
            if not inside:
                seen.add(a, z)
                kept.append((a, z))


def test_long_texts_take_linear_time():
    for unit in ("released under the MIT License and more words. ", "GNU General Public License version 3 ", "cc by nc "):
        took = []
        for n in (500_000, 1_000_000):
            text = licenses.normal((unit * (n // len(unit))).encode())[0]
            start = time.perf_counter()
            assert len(licenses.base_places(text)) + len(licenses.matcher().detections(text.decode())) > 1000
            took.append(time.perf_counter() - start)
        assert took[1] < 3 * took[0] + 0.3, (unit, took)
