import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import patterns
from marginalia.functions.scalar import close_distance, levenshtein, skipgrams
from marginalia.operators import frequencies as fr
from marginalia.operators import vocabularies as vo
from marginalia.sources.shared import gathered

DOCS = [["a", "b", "a", "c"], ["b", "a"], [], None, ["c"]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "doc_id int, tokens array<string>")


def py_ngrams(tokens, n):
    full = ["<s>"] * (n - 1) + tokens + ["</s>"] * (n - 1)
    return [" ".join(full[i : i + n]) for i in range(len(full) - n + 1)]


def counts():
    return {n: Counter(g for d in DOCS if d is not None for g in py_ngrams(d, n)) for n in (1, 2, 3)}


def test_ngram_counts_and_totals(docs):
    table = fr.count_ngrams(docs, "tokens", 3)
    got = {(r.n, r.ngram): r.freq for r in table.collect()}
    assert got == {(n, g): f for n, c in counts().items() for g, f in c.items()}
    tot = {r.n: (r.total_tokens, r.total_types) for r in fr.totals(table).collect()}
    assert tot == {n: (sum(c.values()), len(c)) for n, c in counts().items()}


def test_probabilities(docs, spark):
    table, c = fr.count_ngrams(docs, "tokens", 3).cache(), counts()
    asked = spark.createDataFrame([("a",), ("a b",), ("b a",), ("zz",), ("a zz",), ("<s> a",), ("b a c",)], "ngram string")
    freq = lambda g: 4 if set(g.split()) in ({"<s>"}, {"</s>"}) else c[g.count(" ") + 1][g]
    head = lambda g: freq(g.rpartition(" ")[0]) if " " in g else sum(c[1].values())
    cond = lambda g, k=0.0: (freq(g) + k) / (head(g) + k * len(c[1])) if head(g) else 0.0
    for r in fr.probabilities(table, asked).collect():
        assert r.prob == pytest.approx(c[r.n][r.ngram] / sum(c[r.n].values()))
    for r in fr.probabilities(table, asked, "laplace").collect():
        assert r.prob == pytest.approx((c[r.n][r.ngram] + 1) / (sum(c[r.n].values()) + len(c[1])))
    for r in fr.conditional_probabilities(table, asked, 4).collect():
        assert r.prob == pytest.approx(cond(r.ngram)), r
    for r in fr.conditional_probabilities(table, asked, 4, "laplace", k=0.5).collect():
        assert r.prob == pytest.approx(cond(r.ngram, 0.5)), r
    two = asked.where(F.size(F.split("ngram", " ")) == 2)
    for r in fr.conditional_probabilities(table, two, 4, "interpolation", [0.7, 0.3]).collect():
        want = 0.7 * cond(r.ngram) + 0.3 * cond(r.ngram.split()[1])
        assert r.prob == pytest.approx(want or 1 / sum(c[1].values())), r
    for bad in ([0.5, 0.6], [], None):
        with pytest.raises(ValueError):
            fr.check_lambdas(bad)


def freq_table(spark, c):
    return spark.createDataFrame(list(c.items()), "token string, freq long")


def g2(a, b, t1, t2):
    obs = [[a, b], [t1 - a, t2 - b]]
    n = t1 + t2
    return 2 * sum(o * math.log((o + 1e-20) / (sum(row) * (obs[0][j] + obs[1][j]) / n + 1e-20)) for row in obs for j, o in enumerate(row))


def test_llr_and_spelling(spark):
    a, b = {"x": 10, "y": 3, "old": 8}, {"x": 9, "y": 30, "new": 9}
    t1, t2 = sum(a.values()), sum(b.values())
    rows = {r.token: r for r in fr.compare(freq_table(spark, a), freq_table(spark, b)).collect()}
    for w in {*a, *b}:
        assert rows[w].llr == pytest.approx(g2(a.get(w, 0), b.get(w, 0), t1, t2))
    assert rows["old"].diff == math.inf and rows["y"].direction == "less" and rows["old"].direction == "more"
    diff = fr.spelling_diff(freq_table(spark, a), freq_table(spark, b))
    assert {r.token for r in fr.frequent_words(diff, min_freq=9).collect()} == {"x", "y", "new"}
    assert {r.token for r in fr.frequent_words(diff, min_frac=0.4).collect()} == {"x", "y"}
    levels = fr.change_levels(diff)
    assert {r.token: r.level for r in levels.collect()} == {"old": "disappear", "new": "emerge", "x": "decrease", "y": "increase"}
    vectors = spark.createDataFrame([("old", [1.0, 0.0]), ("new", [0.9, 0.1]), ("x", [0.0, 1.0]), ("y", [0.5, -1.0])], "token string, vector array<double>")
    got = {(r.drop, r.jump, r.change) for r in fr.linked_changes(levels, vectors).collect()}
    assert got == {("old", "new", "replace"), ("x", None, "decrease"), (None, "y", "increase")}
    with pytest.raises(ValueError):
        fr.frequent_words(diff)


def test_cooccurrences(docs):
    got = {(r.term1, r.term2): r.freq for r in fr.cooccurrences(docs, "tokens", 1).collect()}
    want = Counter((d[i], d[j]) for d in DOCS if d for i in range(len(d)) for j in range(i + 1, min(len(d), i + 3)))
    assert got == want
    assert {r.term2 for r in fr.cooccurring(fr.cooccurrences(docs, "tokens", 0), "a").collect()} == {"b", "c"}


def test_vocabulary(spark):
    df = spark.createDataFrame([(3, "B"), (1, "c"), (2, "b"), (4, None), (5, "c")], "at int, term string")
    assert {r.term: r.id for r in vo.vocabulary(df, order="at").collect()} == {"c": 0, "b": 1, "B": 2}
    assert {r.term: r.id for r in vo.vocabulary(df, ignorecase=True).collect()} == {"b": 0, "c": 1}


def test_close_keywords_lose_nothing(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "keyword string")
    for most, ratio in ((3, 0.3), (2, 0.5), (1, 0.9), (3, 0.9), (5, 0.6)):
        got = {(r.a, r.b) for r in vo.close_keywords(df, max_distance=most, max_ratio=ratio).collect()}
        assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if close_distance(a, b, most, ratio)}, most
    pairs = vo.close_keywords(df)
    near = {r.keyword: r.close for r in vo.grouped_close_keywords(pairs).collect()}
    assert all(k in near[o] for k, os in near.items() for o in os)
    for r in vo.closer_terms(pairs).collect()[:20]:
        assert r.distance == min(levenshtein(r.term, o) for o in near[r.term]) == levenshtein(r.term, r.other)


def test_rank_similar(spark):
    words = ["testing", "resting", "tasting", "test", "casting", "unrelated"]
    df = spark.createDataFrame([(w,) for w in [*words, "testing"]], "term string")
    index = vo.skipgram_index(df).cache()
    rows = vo.rank_similar(index, index.where("term = 'testing'"), top_n=3, score_cutoff=0.2).collect()
    v = {w: Counter(g.string for g in skipgrams(w)) for w in words}
    cos = lambda a, b: sum(v[a][g] * v[b][g] for g in v[a]) / math.sqrt(sum(x * x for x in v[a].values()) * sum(x * x for x in v[b].values()))
    want = sorted(((-cos("testing", w), w) for w in words if abs(len(w) - 7) <= 2 and cos("testing", w) >= 0.2))[:3]
    assert [(r.term, r.rank) for r in sorted(rows, key=lambda r: r.rank)] == [(w, i + 1) for i, (_, w) in enumerate(want)]
    assert rows[0].score == pytest.approx(1.0)


def slow_bpe(tokens, k):
    types = {t: [*t, " "] for t in tokens}
    merges = []
    for _ in range(k):
        c = Counter()
        for t, s in types.items():
            for p in set(zip(s, s[1:])):
                c[p] += tokens[t]
        if not c:
            break
        (a, b), f = min(c.items(), key=lambda x: (-x[1], len(x[0][0] + x[0][1]), x[0]))
        merges.append((a, b, f))
        for t, s in types.items():
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            types[t] = out
    return merges


def test_byte_pair_encoding(spark):
    tokens = {"hop": 4, "hopper": 2, "topper": 6, "wiser": 3, "hip": 2, "aaaa": 1}
    df = spark.createDataFrame([(t,) for t, n in tokens.items() for _ in range(n)], "token string")
    symbols, merges = vo.byte_pair_encoding(df, 9, keep_every=3)
    want = slow_bpe(tokens, 9)
    assert [(r.left, r.right, r.freq) for r in merges.orderBy("step").collect()] == want
    assert {r.symbol for r in symbols.collect()} == {c for t in tokens for c in t} | {" "} | {a + b for a, b, _ in want}
    one = spark.createDataFrame([("b",)], "token string")
    assert vo.byte_pair_encoding(one, 50)[1].count() == 1  # no pair is left
    counts_ = vo.pair_counts(vo.bpe_tokens(df))
    change = spark.createDataFrame([("h", "o", -6), ("q", "q", 99)], "left string, right string, delta long")
    new = vo.update_pair_counts(counts_, change)
    assert new.where("left = 'h' and right = 'o'").count() == 0
    assert [(r.left, r.freq) for r in vo.pairs_of_max_frequency(new).collect()] == [("q", 99)]


def test_patterns(spark):
    text = "Op maandag, den 3 sept. sprak Jan van der Berg en Piet de Wit te Delft, burgemeester; zie Kees Smit, Jan Bos en Piet Vos junior in Gouda, 4 uren's avonds"
    df = spark.createDataFrame([(text,)], "t string")
    get = lambda n: [r for c in patterns.PATTERNS[n].extract("t") for r in df.select(c.alias("x")).first().x]
    assert get("weekday_comma_day_month") == ["maandag", "3", "sept."] and get("day_part") == ["avonds"] and get("time") == ["4", "uren"]
    assert get("name_sequence") == ["Kees Smit", "Jan Bos", "Piet Vos junior"] and "Gouda" in get("in_placename")
    assert "Jan van der Berg" in get("name")
    near = patterns.with_context("burgemeester", "dutch_place_name")
    assert set(near) == {"in_placename_comma_then_context", "context_then_in_placename", "in_placename_before_context", "context_before_in_placename"}
    assert patterns.pattern_names("dutch_person_name") == ["name", "name_and_name", "name_sequence"]
    with pytest.raises(KeyError):
        patterns.context_patterns("none")


def test_probabilities_of_counted_ngrams_join_nothing_large(spark, docs):
    """Where the frequency is known it isn't looked up again; the totals alone are joined, by broadcast."""
    table = fr.count_ngrams(docs, "tokens", 3)
    got = fr.probabilities(table, table.select("ngram", "freq"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    looked_up = fr.probabilities(table, table.select("ngram"))
    assert sorted((r.ngram, r.freq, r.prob) for r in got.collect()) == sorted((r.ngram, r.freq, r.prob) for r in looked_up.collect())


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_ngrams_are_counted_before_they_are_shuffled(spark, monkeypatch, most):
    """Blocks of any size give the same counts, and a table of equal texts sends a row per n-gram and block instead of one per place."""
    rng = random.Random(most)
    lists = [[rng.choice(["a", "b", "é", "a b", "<s>", ""]) for _ in range(rng.choice([0, 0, 1, 2, 9]))] for _ in range(60)]
    want = Counter((n, g) for t in lists for n in range(1, most + 1) for g in py_ngrams(t, n))
    for block in (1, 7, 50, fr.BLOCK):
        monkeypatch.setattr(fr, "BLOCK", block)
        got, batches = Counter(), [pa.RecordBatch.from_arrays([pa.array(lists[i:j], pa.list_(pa.string()))], names=["t"]) for i, j in ((0, 1), (1, 1), (1, 30), (30, 60))]
        for r in (r for b in fr._ngram_rows(most)(iter(batches)) for r in b.to_pylist()):
            got[r["n"], r["ngram"]] += r["freq"]
        assert got == want, block
    same = spark.createDataFrame([(["a", "b", "c"] * 30,)] * 200, "tokens array<string>").coalesce(1)
    table = fr.count_ngrams(same, "tokens", most)
    assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()
    assert {(r.n, r.ngram): r.freq for r in table.collect()} == {k: 200 * v for k, v in Counter((n, g) for n in range(1, most + 1) for g in py_ngrams(["a", "b", "c"] * 30, n)).items()}


def test_partitions_follow_the_size_of_the_tables(spark, tmp_path):
    spark.range(300_000).selectExpr("array(uuid(), uuid()) as tokens").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size > 10 << 20
    assert gathered(table, table, "tokens", mb=1).rdd.getNumPartitions() == size >> 20
    assert gathered(table, table, "tokens", mb=4096).rdd.getNumPartitions() <= 8


def test_close_keywords_of_a_small_table_send_nothing_to_the_driver(spark, tmp_path):
    """A small file of words has fifty times as many strings: they meet in a join that doesn't go by the file's size."""
    rng = random.Random(8)
    spark.createDataFrame([("".join(rng.choices("abcdefg", k=rng.randint(1, 12))),) for _ in range(400)], "keyword string").write.parquet(f"{tmp_path}/k")
    pairs = vo.close_keywords(spark.read.parquet(f"{tmp_path}/k"))
    rows = pairs.collect()
    assert rows and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_probabilities_of_all_counted_ngrams(spark, docs):
    """As looked up one by one, with no join on an n-gram's own count and none of a table of all orders."""
    for order, lambdas in ((2, [0.7, 0.3]), (3, [0.6, 0.3, 0.1]), (3, [0.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0])):
        table = fr.count_ngrams(docs, "tokens", order)
        asked = table.where(F.col("n") == order).select("ngram")
        for how in ({}, {"smoothing": "laplace", "k": 0.5}, {"smoothing": "interpolation", "lambdas": lambdas}):
            got = fr.counted_conditionals(table, order, 4, **how)
            assert {r.ngram: r.prob for r in got.collect()} == {r.ngram: r.prob for r in fr.conditional_probabilities(table, asked, 4, **how).select("ngram", "prob").collect()}
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("LeftOuter") == 1, plan
    none = fr.count_ngrams(docs.where("doc_id = 3"), "tokens", 3)
    assert fr.counted_conditionals(none, 3, 0, "interpolation", [0.6, 0.3, 0.1]).collect() == []
    empty = fr.count_ngrams(docs.where("doc_id = 2"), "tokens", 2)
    assert {r.ngram: r.prob for r in fr.counted_conditionals(empty, 2, 1).collect()} == {"<s> </s>": 1.0}
    for bad in ({"smoothing": "other"}, {"order": 1}, {"smoothing": "interpolation", "lambdas": [0.5, 0.5]}):
        with pytest.raises(ValueError):
            fr.counted_conditionals(none, **{"order": 3, "docs": 0} | bad)


def test_cooccurrences_are_counted_in_blocks(spark, docs, monkeypatch):
    """No hash map of a partition's pairs ahead of the shuffle, whatever the size of a block."""
    rng = random.Random(2)
    lists = [[rng.choice(["a", "b", "é", ""]) for _ in range(rng.choice([0, 1, 2, 9]))] for _ in range(60)]
    for skip in (0, 2):
        want = Counter((t[i], t[i + k]) for t in lists for k in range(1, skip + 2) for i in range(len(t) - k))
        for block in (1, 7, fr.BLOCK):
            monkeypatch.setattr(fr, "BLOCK", block)
            got = Counter()
            for b in fr._pair_rows(skip)(iter([pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["t"])])):
                for r in b.to_pylist():
                    got[r["term1"], r["term2"]] += r["freq"]
            assert got == want
    plan = fr.cooccurrences(docs, "tokens", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.rindex("HashAggregate") < plan.index("Exchange")
