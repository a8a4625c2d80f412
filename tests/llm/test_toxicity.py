import math
import random

import numpy as np

from marginalia.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string, p_toxic string, rejected int", "doc_id long, toxic int, quality int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["idiot", "worthless", "zorkig", "blenbor"]
    out = []
    for i in range(n):
        w, toxic = rng.choices(vocab, k=80), rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(bad)
        out.append((i, " ".join(w), int(toxic)))
    return out


def frames(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(i, t, "x", 1) for i, t in extra], DOCS)
    return docs, spark.createDataFrame([(i, y, 1) for i, _, y in rows], LABELS)


def by_hand(chain, text):
    """The chain's probabilities by plain sums."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = set(), b""
    for c in low.encode() + b" ":
        if 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        elif word:
            words |= {word} | ({word[:5] + b"*"} if len(word) > 5 else set())
            word = b""
    out = []
    for j in range(len(chain.names)):
        z = chain.bias[j] + sum(chain.words[chain.index[w], j] for w in words if w in chain.index) + sum(chain.earlier[j, i] * out[i] for i in range(j))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


ODD = [None, "", " 12 !?", "IDIOT", "idiot" * 3000, "é ÉÉÉ " * 20000, "idiot\x00worthless"]


def test_held_out_accuracy_and_brute_force(spark):
    rows, held = corpus(1500), corpus(600, seed=2)
    docs, labels = frames(spark, rows)
    chain = tx.train(docs, labels)
    assert chain.names == ["insult", "contempt", "threat", "toxic"]
    extra = [(10000 + i, t) for i, t, _ in held] + [(20000 + i, t) for i, t in enumerate(ODD)]
    more = spark.createDataFrame([(i, t, "x", 1) for i, t in extra] * 2, DOCS)
    got = tx.score(more, chain).collect()
    assert len(got) == 2 * len(extra)
    texts = dict(extra)
    for r in got[::7]:
        assert np.allclose(list(r)[1:-1], by_hand(chain, texts[r.doc_id]), atol=1e-9)
    rejected = {r.doc_id for r in got if r.rejected}
    truth = {10000 + i for i, _, y in held if y}
    assert len(rejected & truth) >= 0.97 * len(truth) and len({x for x in rejected if x < 20000} - truth) <= 0.02 * len(held)
    assert {x for x in texts if x not in rejected} == {r.doc_id for r in tx.drop_toxic(more, chain).collect()}
    assert tx.drop_toxic(more, chain).columns == more.columns


def test_later_links_use_earlier_ones():
    rng = np.random.default_rng(0)
    a = rng.random(800) < 0.3
    docs = [{b"w%d" % x for x in rng.integers(0, 50, 12)} | ({b"sign"} if t else set()) for t in a]
    chain = tx.fit_chain(docs, {"first": a, "toxic": a & (rng.random(800) < 0.95)})
    assert chain.earlier[1, 0] > 0.1 and not chain.earlier[0].any()


def test_labels_missing_or_of_one_kind(spark):
    rows = corpus(40)
    docs, labels = frames(spark, rows)
    for some in (labels.where("doc_id < 0"), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic", "quality")):
        assert not any(r.rejected for r in tx.score(docs, tx.train(docs, some)).collect())
    chain = tx.train(docs, labels)
    assert tx.score(docs.where("doc_id < 0"), chain).collect() == []
    again = tx.train(docs.unionByName(docs), labels.unionByName(labels.selectExpr("cast(null as long) doc_id", "toxic", "quality")))
    assert again.threshold == chain.threshold and again.index == chain.index


def test_named_categories(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    chain = tx.train(docs, labels, categories=["quality"])
    assert chain.names == ["quality", "toxic"]


def test_threshold():
    assert tx.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == 0.55
    assert 0.1 <= tx.best_threshold(np.array([0.2, 0.2]), np.array([1, 0])) <= 0.2


def test_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    out = tx.op8_classifier_chain(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    hit = [r.rejected for r in out if r.toxic]
    miss = [r.rejected for r in out if not r.toxic]
    assert sum(hit) >= 0.9 * len(hit) and sum(miss) <= 0.02 * len(miss)
