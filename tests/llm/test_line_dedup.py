import random
import re
import time
from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import functions as F
from sql_check import same

from marginalia.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, line int, drop string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def taken(words, k):
    """Places of runs of k words that are looked at, window by window."""
    h = [reduce(lambda a, c: (a * 1000003 + c + 1) % 2**31, w.encode(), 0) for w in words]
    v = [sum(weight * h[i + (k - 1) * j // 3] for j, weight in enumerate((1, 3, 5, 7))) % 2**31 * 1640531527 % 2**31 for i in range(len(words) - k + 1)]
    if not v:
        return set()
    starts = range(max(1, len(v) - k + 1))
    return {min(range(s, min(len(v), s + k)), key=lambda i: (v[i], i)) for s in starts} | {0, len(v) - 1}


def brute(docs, p=ld.PARAMS):
    """docs: {id: text}. {id: (dropped lines, words that go, text)}."""
    rows, runs, plain = [], defaultdict(list), {}
    for d, t in docs.items():
        key = (d is not None, d or 0)
        plain[key] = [re.findall(WORD, s) for s in (t or "").split("\n")]
        masked = [["<*>" if re.search("[0-9]", x) else x for x in w] for w in plain[key]]
        rows += [(key, i, w) for i, w in enumerate(masked) if w]
        flat = [x for w in masked for x in w]
        for i in taken(flat, p["run"]):
            runs[tuple(flat[i : i + p["run"]])].append((key, i))
    groups = defaultdict(list)
    for d, i, w in rows:
        lead, rest = tuple(w[: p["depth"]]), w[p["depth"] :]
        at = [len(rest) * k // 4 for k in range(5)]
        parts = [tuple(rest[at[k] : at[k + 1]]) for k in range(4)]
        groups[len(w), lead, tuple(parts)].append((d, i, len(w)))
        if len(w) >= p["open_from"]:
            for k in range(4):
                fixed = len(w) - len(parts[k])
                if fixed >= p["min_fixed"]:
                    groups[len(w), lead, k, tuple(parts[j] for j in range(4) if j != k)].append((d, i, fixed))
    drop, under = defaultdict(set), defaultdict(set)
    for g in groups.values():
        need = p["min_docs_long"] if g[0][2] >= p["long_words"] else p["min_docs"]
        if len({d for d, _, _ in g}) >= need:
            first = min((d, i) for d, i, _ in g)
            for d, i, _ in g:
                if (d, i) != first:
                    drop[d].add(i)
    for g in runs.values():
        if len({d for d, _ in g}) > 1:
            for d, i in g:
                if (d, i) != min(g):
                    under[d] |= set(range(i, i + p["run"]))
    out = {}
    for d, t in docs.items():
        key = (d is not None, d or 0)
        at, lost, went, kept = 0, 0, [], []
        for i, (s, w) in enumerate(zip((t or "").split("\n"), plain[key])):
            left = [x for j, x in enumerate(w) if i not in drop[key] and at + j not in under[key]]
            at, lost = at + len(w), lost + len(w) - len(left)
            if len(left) == len(w):
                kept.append(s)
            elif left:
                kept.append(" ".join(left))
            else:
                went.append(i)
        whole = lost >= p["whole"] * at
        out[d] = ([], 0, t) if whole else (went, lost, None if t is None else "\n".join(kept))
    return out


def check(rows, docs):
    want = brute(docs)
    for r in rows:
        went, lost, text = want[r.doc_id]
        assert r.dropped_lines == ",".join(map(str, went)) and (r.n_dropped, r.n_words) == (len(went), lost), r.doc_id
        assert r.text == text, r.doc_id
        t = docs[r.doc_id]
        assert r.n_lines == (0 if t is None else t.count("\n") + 1)


def test_table_and_sql(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = ld.op5_template_lines(spark, sf_dir)
    check(out.collect(), docs)
    same(out, ld.SQL["op5_template_lines"], sf_dir)


def query(df):
    d = ld.dedup(df)
    return d.select("d.doc_id", "n_lines", F.size("dropped").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped_lines"), "n_words", F.col("kept_text").alias("text")).collect()


def fresh(rng, n):
    return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "d", 0) for i, t in docs.items()], SCHEMA)


def test_odd_texts(spark):
    rng = random.Random(2)
    own = lambda: " ".join(fresh(rng, 20))
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    edited = passage.replace("wba", "other", 1)
    texts = [None, "", "\n\n", "Page 1 of 9\nown a", "Page 2 of 9\nown b", "Page 33 of 9\nown c", "Page x1 of 12\nown d", "Page 1 of 1\nown e", passage + "\n" + own(), own() + "\n" + passage, passage, edited + "\n" + own(), "short line\nunique one", "short line\nunique two", "a\n\n \nb", "user ann logged in from host one at noon today\nx1 own words here", "user ann logged in from host two at noon today\ny2", "x " * 30000, "same\nsame\nsame"]
    docs = dict(enumerate(texts))
    df = frame(spark, docs)
    rows = query(df)
    assert len(rows) == len(docs)
    check(rows, docs)
    got = {r.doc_id: r.n_dropped for r in rows}
    assert got[9] == got[11] == 0 and got[8] == 0 and got[10] == 0 and got[12] == 0 or got[9] == 1
    twice = spark.createDataFrame([(i, t, 1, "d", 0) for i, t in docs.items()] * 2, SCHEMA)
    again = query(twice)
    assert len(again) == 2 * len(docs)
    check(again, docs)
    out = ld.apply_dedup(df)
    assert out.columns == df.columns and out.count() == len(docs)
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert query(spark.createDataFrame([], SCHEMA)) == []


def test_null_id_is_an_id(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen\n"
    docs = {None: t + "a", 5: t + "b c d e f g h", 6: t + "i j k l m n o p q"}
    rows = query(frame(spark, docs))
    check(rows, docs)
    assert sorted(r.n_dropped for r in rows) == [0, 1, 1]


def test_passages_wherever_they_stand(spark):
    """Of any passage of over 50 words no run of 50 is left in a second document, whatever its lines."""
    rng = random.Random(4)
    broken = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    passages = [fresh(rng, rng.randint(51, 90)) for _ in range(12)]
    docs = {}
    for i, x in enumerate(passages):
        for k in range(3):
            w = fresh(rng, rng.randint(60, 90)) + x + fresh(rng, rng.randint(60, 90))
            docs[3 * i + k] = " ".join(w) if k == 0 else broken(w, rng.randint(5, 40))
    docs[99] = " ".join(fresh(rng, 30) + passages[0][:24] + fresh(rng, 30))  # too short to be a passage
    rows = query(frame(spark, docs))
    check(rows, docs)
    left = {r.doc_id: (r.text.split(), r.n_words) for r in rows}
    for i, x in enumerate(passages):
        assert left[3 * i][1] == 0
        for k in (1, 2):
            w = left[3 * i + k][0]
            assert not any(w[j : j + 50] == x[a : a + 50] for a in range(len(x) - 49) for j in range(len(w) - 49))
    assert left[99][1] == 0


def test_hot_keys(spark, monkeypatch):
    from marginalia.llm import common

    rng = random.Random(5)
    hot = " ".join(fresh(rng, 14))
    docs = {i: "\n".join([hot, " ".join(fresh(rng, 30)), *(["Page 7 of 9"] if i % 3 else [])]) for i in range(40)}
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    check(query(frame(spark, docs)), docs)


def test_long_documents_of_short_lines(spark):
    """A document of 10 MB costs as much as its words; doubling it about doubles the time."""
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8))
    shared = line() + " and more words to make it long"
    big = "\n".join(shared if i % 2000 == 7 else line() for i in range(180_000))
    took = []
    for text in ("x y z", big[: len(big) // 2], big):
        df = spark.createDataFrame([(1, text, 1, "d", 0), (0, "own\n" + shared, 1, "d", 0)], SCHEMA)
        start = time.time()
        rows = {r.doc_id: r for r in query(df)}
        took.append(time.time() - start)
    assert len(big) > 10_000_000 and rows[1].n_dropped == big.count(shared) and rows[0].n_dropped == 0
    assert took[2] < 3 * took[1] + 5
    assert Counter(rows[1].text.split("\n"))[shared] == 0
