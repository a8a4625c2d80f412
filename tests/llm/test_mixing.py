from collections import Counter, defaultdict

import numpy as np

from marginalia.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, size long, _taken string, n_chars long"


def levels(size):
    """{source: target}, by rounds of floats."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    left, open_, level = float(sum(size.values())), list(range(len(names))), {}
    while open_:
        w = sum(i % 3 + 1 for i in open_)
        over = [i for i in open_ if left * (i % 3 + 1) / w > 3 * size[names[i]]]
        for i in over or open_:
            level[names[i]] = 3.0 * size[names[i]] if over else left * (i % 3 + 1) / w
        left -= sum(level[names[i]] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return names, level


def brute(out, sources, block=mixing.BLOCK_WORDS):
    """out: rows of mix(); sources: one for each. Slot by slot: (source_size, target, per row (taken, first slot))."""
    size = Counter()
    for r, s in zip(out, sources):
        size[s] += r.size
    names, level = levels(size)
    total = sum(size.values())
    cum = np.cumsum([level[s] for s in names]) / max(total, 1)
    own, rank = defaultdict(list), Counter()
    for i, (r, s) in enumerate(zip(out, sources)):
        own[s].append((r.start, r.size, i))
    ring = {}
    for s, x in own.items():
        x.sort()
        ring[s] = [i for _, n, i in x for _ in range(n)]
        assert [a for a, n, _ in x if n] == [sum(m for _, m, _ in x[:j]) for j, (_, n, _) in enumerate(x) if n]  # end to end
    taken, first = Counter(), {}
    for k in range(-(-total // block)):
        s = names[min(int(np.searchsorted(cum, (k * mixing.GOLDEN % 2**64) / 2**64, "right")), len(names) - 1)]
        for at in range(rank[s] * block, min((rank[s] + 1) * block, 3 * size[s])):
            i = ring[s][at % size[s]]
            taken[i] += 1
            first.setdefault(i, k)
        rank[s] += 1
    return size, level, taken, first


def check(out, sources):
    size, level, taken, first = brute(out, sources)
    got = Counter()
    for i, (r, s) in enumerate(zip(out, sources)):
        assert r.source_size == size[s] and abs(r.target - level[s]) <= 1e-6 * max(1, level[s])
        assert (r.taken, r.first_slot) == (taken[i], first.get(i)) and 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - level[s]) <= 4 * mixing.BLOCK_WORDS + 0.001 * level[s] for s in size)


def test_table(spark, sf_dir):
    rows = {r.doc_id: (len(r.text.encode().split()), r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = mixing.op10_source_schedule(spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in out} == {d: n for d, (n, _) in rows.items()}
    check(out, [rows[r.doc_id][1] for r in out])
    assert sorted(map(str, out)) == sorted(map(str, mixing.op10_source_schedule(spark, sf_dir).collect()))


def odd(spark):
    rows = [(0, None, "b"), (1, "", "b"), (2, " \t\n", None), (3, "one word two", None), (4, "w " * 3000, "a"), (5, "x " * 50, "é"), (6, "y " * 7, "z"), (7, "x " * 50, "é"), (8, "x", "")]
    return spark.createDataFrame([(i, t, s, 5, "c", len(t or "")) for i, t, s in rows], SCHEMA)


def given(rows, key):
    words = Counter()
    for r in rows:
        words[key(r)] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text)
    return dict(words)


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    df = odd(spark)
    source = {r.doc_id: r.source for r in df.collect()}
    out = mixing.mix(df).collect()
    check(out, [source[r.doc_id] for r in out])
    kept = mixing.apply_mix(df)
    assert kept.columns == df.columns
    assert given(kept.collect(), lambda r: r.doc_id) == {r.doc_id: r.taken for r in out if r.taken}


def test_repeated_and_null_ids_lose_nothing(spark, monkeypatch):
    """Rows of one id, of none, and equal rows, few or hot."""
    rows = [(1, "c " * 5, "x"), (1, "d " * 50, "x"), (None, "e " * 10, "x"), (None, "f " * 100, "x"), *[(7, "g " * 9, "y")] * 30, *[(None, "h " * 3, None)] * 40, *[(None, "", "x")] * 40, (2, "i " * 400, "z")]
    df = spark.createDataFrame([(i, t, s, 0, "", len(t)) for i, t, s in rows], SCHEMA)
    for hot in (50_000, 10):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        out = mixing.mix(df, "doc_id", "text", "source").collect()
        source = {5: "x", 50: "x", 10: "x", 100: "x", 9: "y", 3: None, 0: "x", 400: "z"}
        check(out, [source[r.size] for r in out])
        want = Counter()
        for r in out:
            want[r.doc_id, source[r.size]] += r.taken
        assert given(mixing.apply_mix(df).collect(), lambda r: (r.doc_id, r.source)) == {k: n for k, n in want.items() if n}


def test_order_of_the_schedule(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 40, f"s{i % 3}", 0, "", 0) for i in range(200)], SCHEMA)
    slot = {r.doc_id: r.first_slot for r in mixing.mix(df).collect() if r.taken}
    seen = [r.doc_id for r in mixing.apply_mix(df).collect()]
    first = [i for k, i in enumerate(seen) if i not in seen[:k]]
    assert [slot[i] for i in first] == sorted(slot.values())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.apply_mix(empty).collect() == []
    none = spark.createDataFrame([(1, None, None, 0, "", 0), (2, " ", "a", 0, "", 0)], SCHEMA)
    assert {r.doc_id: (r.size, r.target, r.taken) for r in mixing.mix(none).collect()} == {1: (0, 0.0, 0), 2: (0, 0.0, 0)}
    assert mixing.apply_mix(none).collect() == []


def sources(spark, sizes):
    return spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "_source string, _source_size long, _rows long")


def test_schedule_is_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BITS", 6)  # many cells and chunks
    sizes = {"a": 100, "b": 200, "c": 3700, "d": 0}
    p = mixing.plan(sources(spark, sizes))
    target = {r._s: r._target for r in p.sources.collect()}
    ranked, counts = mixing.schedule(p, 4)
    rows = ranked.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1000))
    seen = Counter()
    for i, r in enumerate(rows):
        assert r["rank"] == seen[r._s]
        seen[r._s] += 1
        assert all(abs(seen[s] - (i + 1) * t / 4000) < 4 for s, t in target.items())
    assert {r._s: r._slots for r in counts.collect()} == dict(seen)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BITS", 4)
    sizes = {None if i == 7 else f"s{i:04}": i * 37 % 211 + i % 7 * 400 for i in range(1500)}
    p = mixing.plan(sources(spark, sizes))
    names, level = levels(sizes)
    got = sorted(p.sources.collect(), key=lambda r: r._s)
    assert [r._sk for r in got] == ["" if s is None else "=" + s for s in names]
    assert all(abs(r._target - level[s]) <= 1e-6 * max(1, level[s]) for r, s in zip(got, names))
    cum = np.cumsum([level[s] for s in names]) / sum(sizes.values())
    want = Counter(min(int(np.searchsorted(cum, (k * mixing.GOLDEN % 2**64) / 2**64, "right")), len(names) - 1) for k in range(-(-sum(sizes.values()) // 16)))
    assert {r._s: r.n for r in mixing.slots(p).groupBy("_s").count().withColumnRenamed("count", "n").collect()} == dict(want)
