import random
import re
from collections import defaultdict

import xxhash

from marginalia.llm import common, simhash

SCHEMA = "doc_id long, text string, fp string, root int"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(fps):
    """fps: {id: fp}. {id: (n_near, component)} by comparing all pairs."""
    ids, near, root = sorted(fps), defaultdict(int), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                near[i] += 1
                near[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (near[i], find(i)) for i in ids}


def check(rows, texts):
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = brute(fps)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and (r.n_near, r.component_id) == want[r.doc_id], r


def test_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(simhash.op9_simhash_near_duplicates(spark, sf_dir).collect(), texts)
    kept = {r.doc_id for r in simhash.keep_first(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert kept == {c for _, c in brute({i: slow_fingerprint(t) for i, t in texts.items()}).values()}


def test_odd_texts(spark):
    odd = [None, "", " \n", "a", "A", "a b", "a  B", "a b c", "a b c d", "É é", "x " * 50000, "a\x85b c", "a\x85b C", "a\x1cb"]
    df = spark.createDataFrame([(i, t, "f", 3) for i, t in enumerate(odd)], SCHEMA)
    check(simhash.near_duplicates(df).collect(), dict(enumerate(odd)))
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_first(empty).collect() == []
    twice = spark.createDataFrame([(5, "a b c d", "f", 1), (5, "a b c d", "f", 2), (None, "q", "f", 1)], SCHEMA)
    assert [r.n_near for r in simhash.near_duplicates(twice).where("doc_id = 5").collect()] == [1, 1]
    assert sorted((r.doc_id or 0) for r in simhash.keep_first(twice).collect()) == [0, 5]


def test_keep_first_of_rows_without_an_id_or_of_one_id(spark, monkeypatch):
    a, b = "one two three four five six", "an other text of its own that is long"
    rows = [(None, a, "x", 1), (None, a, "y", 2), (None, b, "x", 3), (5, b, "z", 4), (5, "quite a different one of the same id", "z", 5), (6, "", "e", 6), (7, None, "e", 7), (None, " ", "e", 8), *[(9, "same row every time", "s", 9)] * 30]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (50_000, 3):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        out = simhash.keep_first(df)
        got = out.collect()
        assert out.columns == df.columns and len(got) == 5
        assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in got) == [(0, "one t"), (5, "an ot"), (5, "quite"), (6, ""), (9, "same ")]
        assert sorted(r.n_near for r in simhash.near_duplicates(df).collect()) == [0, 1, 1, 1, 1, 2, 2, 2, *[29] * 30]


def test_tally_decides(spark):
    assert simhash.least_tally(3) == 2 and len(set(simhash.TRIPLES)) == 16
    far = [0, 0xFF_FF_FF_FF_FF << 24, 0x01_01_01_01_01 << 24]  # three bytes in common
    assert simhash.links(spark.createDataFrame([(signed(x),) for x in far], "fp long")).collect() == []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing_at_any_list_length(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:  # chains and clouds around some
        for _ in range(15):
            b ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))})
            fps.add(b)
    shared = rng.getrandbits(40)
    fps |= {shared | rng.getrandbits(12) << 40 for _ in range(60)}  # five bytes in common
    fps = sorted(signed(x) for x in fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for hot in (512, 8, 2):
        assert {tuple(r) for r in simhash.links(df, hot=hot).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (103, 105)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 105: 100, 103: 100}
