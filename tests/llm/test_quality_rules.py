import math
import random
import re
from collections import Counter

from sql_check import same

from marginalia.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, kept boolean, chars string"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = [None, "", " \t\x0b\n", "a", "a b c a b c", "a b c d a b c", "x x x x x", "x\x85x   x", "é É\n\né É\n \n \n", "|#*$%&<>" * 80, "w " * 20000, "ab " * 49, "one two three " * 40, "a\r\nb\r\na\r\n"]


def check(r, text):
    n = slow(text)
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, text
    assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r.base_failed or not r.kept)


def test_sql(spark, sf_dir):
    same(q.op6_divergence_rules(spark, sf_dir), q.SQL["op6_divergence_rules"], sf_dir)


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", True, "c") for i, t in enumerate(ODD)] * 2, SCHEMA)
    rows = q.assess(df).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        check(r, ODD[r.doc_id])
    assert q.assess(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeats_against_brute_force():
    rng = random.Random(2)
    for n in list(range(12)) * 8 + [500, 3000]:
        t = " ".join(rng.choices("abc" if n < 100 else "abcdefghijklmnop", k=n))
        assert q.measure(t)[4] == slow(t)[4], t


def distance(a, b):
    a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
    half = lambda x, y: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(x, y) if u)
    return math.sqrt(max(0, half(a, b) + half(b, a)) / 2)


def test_verdicts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    clean = [" ".join(rng.choice(["the", "of", "and", word(), word()]) for _ in range(200)).capitalize() + "." for _ in range(80)]
    junk = [" ".join(word() + "###" for _ in range(200)) for _ in range(8)]
    short = ["### " * 40]
    texts = clean + junk + short
    df = spark.createDataFrame([(i, t, "en", True, "c") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in q.assess(df).collect()}
    assert all(rows[i].kept for i in range(80)) and not any(rows[i].kept for i in range(80, 89))
    counts = [q.measure(t)[5] for t in clean]
    mean = [sum(c[i] / sum(c) for c in counts) for i in range(q.N_CHAR)]  # the junk is trimmed
    for i in (0, 7, 83):
        assert abs(rows[i].char_distance - distance(q.measure(texts[i])[5], mean)) < 1e-5
    assert rows[88].char_distance is None  # too short to tell


def test_labelled_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    out = q.op6_divergence_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0 and r.n_words >= 150]
    assert sum(good) / len(good) > 0.995 and sum(bad) / max(1, len(bad)) < 0.1
