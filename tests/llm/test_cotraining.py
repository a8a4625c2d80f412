import random

import numpy as np

from marginalia.llm import cotraining as ct

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"


def corpus(n, seed=1):
    """Good and bad documents whose text and source both tell them apart, most of the time."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "of", word()]) if good else word() + rng.choice(["###", "%", ""]) for _ in range(60)]
        source = f"good{rng.randrange(5)}" if good == (rng.random() < 0.97) else f"bad{rng.randrange(5)}"
        text = " ".join(words)
        out.append((i, text, "en", source, len(text), "x", 0, int(good)))
    return out


def frames(spark, rows, labelled):
    docs = spark.createDataFrame([r[:7] for r in rows], SCHEMA)
    return docs, spark.createDataFrame([(r[0], r[7]) for r in rows[:labelled]], "doc_id long, quality int")


def test_views_teach_each_other_and_hold_out_well(spark):
    rows = corpus(2000)
    docs, labels = frames(spark, rows, 400)
    model = ct.train(docs, labels)
    assert sum(a for a, _ in model.exchanged) > 100 and sum(b for _, b in model.exchanged) > 100
    got = {r.doc_id: r for r in ct.score(docs, model).collect()}
    assert len(got) == len(rows)
    held = rows[400:]
    assert np.mean([(got[r[0]].score > 0.5) == r[7] for r in held]) > 0.97
    for view in ("p_content", "p_metadata"):
        assert np.mean([(got[r[0]][view] > 0.5) == r[7] for r in held]) > 0.9
    assert np.mean([got[r[0]].kept for r in held if r[7]]) > 0.99
    mean = np.mean([got[r[0]].score for r in held])
    assert abs(mean - np.mean([r[7] for r in held])) < 0.05  # calibrated
    for r in rows[:50]:  # against the model applied one by one
        one = model.score([np.array([ct.content(r[1])]), np.array([ct.metadata(r[2], r[3], r[4])])])
        assert np.allclose([x[0] for x in one], [got[r[0]].p_content, got[r[0]].p_metadata, got[r[0]].score])


def test_table_against_brute_force(spark, sf_dir):
    """The query's scores, with all of training redone on arrays in one place."""
    from pyspark.sql import functions as F

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", F.xxhash64(F.lit(ct.PARAMS["seed"]), "doc_id").alias("o")).collect()
    label = {r.doc_id: int(r.quality > 0) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    rows = {r.doc_id: (r.o, ct.content(r.text or ""), ct.metadata(r.lang, r.source, r.n_chars)) for r in docs}
    own = sorted(d for d in rows if d in label)
    rest = [d for d in rows if d not in label]
    x = [np.array([rows[d][i] for d in rest]) for i in (1, 2)]

    def surest(views, asks, taken):
        out = []
        for v, want, n, least in asks:
            p = ct.sigmoid(views[v].logit(x[v]))
            sure = np.round(p if want else 1 - p, 9)
            best = sorted((-sure[i], rows[d][0], d, i) for i, d in enumerate(rest) if sure[i] >= least and d not in taken[v])[:n]
            out.append(([b[2] for b in best], [part[[b[3] for b in best]] for part in x]))
        return out

    model = ct.cotrain([np.array([rows[d][i] for d in own]) for i in (1, 2)], np.array([label[d] for d in own]), surest)
    assert all(a and m for a, m in model.exchanged)  # both views give
    for r in ct.op1_cotraining_quality(spark, sf_dir).collect():
        one = model.score([np.array([rows[r.doc_id][1]]), np.array([rows[r.doc_id][2]])])
        assert np.allclose([v[0] for v in one], [r.p_content, r.p_metadata, r.score], atol=1e-6)
        assert r.kept == (one[2][0] >= model.threshold) or abs(one[2][0] - model.threshold) < 1e-6


def test_odd_rows(spark):
    rows = corpus(300)
    docs, labels = frames(spark, rows, 200)
    model = ct.train(docs.unionByName(docs), labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")))
    odd = [None, "", " \n", "x" * 50000, "word " * 30000, "é\x00"]
    df = spark.createDataFrame([(i, t, None, None, None if i % 2 else -5, "s", 1) for i, t in enumerate(odd)] * 2, SCHEMA)
    out = ct.score(df, model).collect()
    assert len(out) == 2 * len(odd) and all(0 <= r.score <= 1 and r.kept is not None for r in out)
    assert len({(r.doc_id, r.score) for r in out}) == len(odd)
    assert ct.score(docs.where("doc_id < 0"), model).collect() == []


def test_labels_missing_or_of_one_class(spark):
    docs, labels = frames(spark, corpus(60), 40)
    for some in (labels.where("doc_id < 0"), labels.where("quality = 1")):
        out = ct.score(docs, ct.train(docs, some)).collect()
        assert len({round(r.score, 9) for r in out}) == 1 and all(r.kept for r in out)


def test_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    out = ct.op1_cotraining_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept for r in out if r.quality]) > 0.99 and np.mean([r.kept for r in out if not r.quality]) < 0.3
