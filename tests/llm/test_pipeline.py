import re
from collections import Counter, defaultdict

import test_line_dedup
import test_mixing
import test_packing
import test_simhash

import corpus_pipeline as cp
from marginalia.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    before = docs
    out = {}
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        before = spark.createDataFrame(after.toPandas().astype(object).where(lambda x: x.notna(), None), docs.schema)
        out[name] = before.collect()
    start = {r.doc_id: r for r in docs.collect()}
    # Toxicity drops whole rows, hardly any clean one.
    left = {r.doc_id: r for r in out["toxicity"]}
    assert all(start[i] == r for i, r in left.items())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert sum(r.doc_id in left for r in labels if not r.toxic) >= 0.97 * sum(not r.toxic for r in labels)
    assert sum(r.doc_id in left for r in labels if r.toxic) <= 0.2 * sum(r.toxic for r in labels)
    # Line dedup.
    gone = test_line_dedup.brute({i: r.text for i, r in left.items()})
    lines = {r.doc_id: r for r in out["line_dedup"]}
    assert set(lines) == set(left)
    for i, r in lines.items():
        assert r.text == gone[i][2] and r.n_chars == len(r.text)
    # One of each group of near-duplicates.
    near = test_simhash.brute({i: test_simhash.slow_fingerprint(r.text) for i, r in lines.items()})
    kept = {r.doc_id: r for r in out["near_duplicates"]}
    assert set(kept) == {c for _, c in near.values()} and all(lines[i] == r for i, r in kept.items())
    # Mixing: every source near its target, no document above three times its words.
    got, by_source, size = Counter(), Counter(), Counter()
    for r in out["mixing"]:
        got[r.doc_id] += words(r.text)
        assert kept[r.doc_id].text.startswith(r.text) and r.source == kept[r.doc_id].source
    for i, r in kept.items():
        size[r.source] += words(r.text)
        by_source[r.source] += got[i]
        assert got[i] <= 3 * words(r.text)
    for s, t in test_mixing.levels(size)[1].items():
        assert abs(by_source[s] - t) <= 5 * mixing.BLOCK_WORDS
    # Packing: as many ids a document as its rows have.
    want = defaultdict(int)
    for r, ids in zip(out["mixing"], test_packing.library_ids([r.text for r in out["mixing"]])):
        want[r.doc_id] += len(ids)
    pieces = cp.packing_stage(spark, before, sf_dir).collect()
    have = Counter()
    for r in pieces:
        have[r.doc_id] += r.length
    assert have == want


def test_run_equals_its_stages(spark, sf_dir):
    rows = cp.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    again = Counter()
    for r in cp.packing_stage(spark, docs, sf_dir).collect():
        again[r.doc_id] += r.length
    have = Counter()
    for r in rows:
        have[r.doc_id] += r.length
    assert have == again


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_odd_rows_at_every_stage(spark, sf_dir):
    """Nulls in every column, repeated and empty rows, rows without an id, a long text, columns named as the operators' own."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()
    long_ = "\n".join(f"line {i} of a long text that is its own " + "abcdefghij"[i % 10] * (i % 17 + 1) + str(i) for i in range(20_000))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in plain] * 2
    rows += [(None, None, None, None, None)] * 20 + [(None, "", None, "s", 0)] * 20 + [(5000, None, "en", None, None), (5001, "", "en", "s", 0), (5002, " \n\t", "en", "s", 3), (5003, long_, "en", "s", len(long_))]
    rows += [(5004, f"rows of one id and text number {w} of its own words {w} {w}", "en", "s", 60) for w in ("alpha beta gamma", "delta epsilon", "zeta eta theta iota")]
    names = ["d", "doc", "slot", "words", "_size", "fp", "drop", "x"]
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in cp.STAGES[:-1]:
        before = df
        df = stage(spark, df, sf_dir)
        assert df.columns == before.columns and df.dtypes == before.dtypes, name
        got = df.collect()
        df = spark.createDataFrame(got, before.schema)
        assert all(tuple(r[n] for n in names) == tuple(range(8)) for r in got)
        if name == "toxicity":
            assert len(got) > 0.9 * len(rows)
        if name == "line_dedup":
            assert len(got) == before.count() and sum(r.doc_id == 5004 for r in got) == 3
        if name == "near_duplicates":
            assert sum(not words(r.text) for r in got) == 1 and sum(r.doc_id == 5004 for r in got) == 3 and len({(r.doc_id, r.text) for r in got}) == len(got)
            size = Counter()
            for r in got:
                size[r.source] += words(r.text)
        if name == "mixing":
            have = Counter()
            for r in got:
                have[r.source] += words(r.text)
            assert all(abs(have[s] - t) <= 5 * mixing.BLOCK_WORDS for s, t in test_mixing.levels(size)[1].items())
    assert cp.packing_stage(spark, df, sf_dir).count() >= df.count()
