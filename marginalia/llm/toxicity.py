"""Toxicity by a chain of classifiers.

Categories come in a fixed order; the link of each is a linear (logistic) model over a document's words and five-byte word
beginnings and over the probabilities of all earlier categories. A link is trained with out-of-fold probabilities of the
earlier ones, so it sees them as wrong as they will be; for scoring every link is fitted on the whole sample. The last link is
the labelled `toxic` itself; earlier ones are the labelled columns named in `categories`, or, where a category has only seed
words, toxic documents that hold one of them. So without such columns three of the four links are models of word lists within toxic documents; what
they add is what the last link makes of their probabilities. The threshold maximises F1 of the last link's out-of-fold probabilities; if that is
below `least_f1`, the labels don't tell toxic documents from others and nothing is rejected.

The sample that the chain is fitted on is bounded: at most `max_positive` toxic and `max_negative` other labelled documents,
those of least hash of the id. Features are those of the sample that are in three of its documents or more, of highest chi-square: `max_features` of
them at most, and one for three documents of the sample (or 100), as few documents can't tell many apart. Scoring reads every document
once and shuffles nothing.

Words are runs of ASCII letters and of bytes beyond ASCII, A-Z lower-cased. Nulls: a null text is an empty one; null labels and
ids don't count for training. Several labels of a document: the largest. With no toxic or no other label, every probability is
the smoothed share of toxic ones and nothing is rejected. Empty tables give empty results, repeated rows repeated ones; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_docs, stored, table

#: Seed words of the categories ahead of `toxic`, in the chain's order.
SEEDS = {
    "insult": "idiot moron stupid clown loser fool dumb imbecile idiota imbécile estúpido dummkopf trottel idiotin crétin tonto",
    "contempt": "worthless pathetic trash scum disgusting garbage filth vermin abschaum müll ordure racaille basura escoria",
    "threat": "kill murder hurt beat shoot stab hang töten umbringen tuer frapper matar golpear",
}
PARAMS = {"max_positive": 4000, "max_negative": 8000, "max_features": 3000, "folds": 4, "l2": 0.3, "steps": 60, "least_f1": 0.5, "seed": 8}
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(text: bytes) -> set[bytes]:
    """A text's distinct words, and beginnings of longer ones, marked by a star."""
    words = set(text.translate(_LETTERS).split())
    return words | {w[:5] + b"*" for w in words if len(w) > 5}


def _fit(idx: np.ndarray, rows: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, k: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic weights by full-batch Adam; idx, rows: columns and rows of the ones of a sparse 0/1 matrix. Classes weigh alike."""
    m = extra.shape[1]
    x = np.zeros(k + m + 1)
    x[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, n - y.sum()))
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        z = np.bincount(rows, x[idx], minlength=n) + extra @ x[k : k + m] + x[-1]
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(idx, r[rows], minlength=k), extra.T @ r, [r.sum()]])
        g[:-1] += l2 / n * x[:-1]
        m1 += 0.1 * (g - m1)
        m2 += 0.02 * (g * g - m2)
        x -= 0.15 * (1 - t / (steps + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.98**t)) + 1e-9)
    return x[:k], x[k : k + m], float(x[-1])


@dataclass
class Chain:
    names: list[str]
    index: dict[bytes, int]
    words: np.ndarray  # features by links
    earlier: np.ndarray  # link j's weights of links before it
    bias: np.ndarray
    threshold: float

    def probs(self, found: list[int]) -> list[float]:
        """The links' probabilities of a document with these features."""
        z = self.words[found].sum(0) + self.bias
        out: list[float] = []
        for j in range(len(self.names)):
            x = z[j] + sum(w * p for w, p in zip(self.earlier[j], out))
            out.append(float(1 / (1 + np.exp(-max(-30.0, min(30.0, x))))))
        return out

    def score(self, text: bytes) -> list[float]:
        return self.probs([self.index[f] for f in self.index.keys() & features(text)])


def vocabulary(docs: list[set[bytes]], y: np.ndarray, most: int) -> dict[bytes, int]:
    """The features of highest chi-square with the label, of those in three documents or more; ties by the feature."""
    pos: dict[bytes, int] = {}
    all_: dict[bytes, int] = {}
    for d, t in zip(docs, y):
        for f in d:
            all_[f] = all_.get(f, 0) + 1
            if t:
                pos[f] = pos.get(f, 0) + 1
    n, n1 = len(docs), max(1.0, float(y.sum()))
    names = [f for f, c in all_.items() if c >= 3]
    a = np.array([pos.get(f, 0) for f in names], float)
    c = np.array([all_[f] for f in names], float)
    want = c * n1 / n
    chi = (a - want) ** 2 / (want + 1e-9) + (a - want) ** 2 / (c - want + 1e-9)
    best = sorted(range(len(names)), key=lambda i: (-chi[i], names[i]))[:most]
    return {names[i]: j for j, i in enumerate(best)}


def fit_chain(docs: list[set[bytes]], labels: dict[str, np.ndarray], **params) -> Chain:
    """A chain from few documents at hand. labels: 0/1 per document by category, in the chain's order, the verdict last."""
    p = PARAMS | params
    index = vocabulary(docs, list(labels.values())[-1].astype(float), _width(len(docs), p)) if docs else {}
    return fit_links([[index[f] for f in index.keys() & d] for d in docs], index, labels, **params)


def _width(n: int, p: dict) -> int:
    """Few documents can't tell many features apart."""
    return min(p["max_features"], max(100, n // 3))


def fit_links(got: list[list[int]], index: dict[bytes, int], labels: dict[str, np.ndarray], **params) -> Chain:
    """A chain from the feature numbers of documents."""
    p = PARAMS | params
    names, n = list(labels), len(got)
    verdict = labels[names[-1]].astype(float) if n else np.zeros(0)
    if n == 0 or verdict.sum() in (0, n):
        b = float(np.log((verdict.sum() + 1) / (n - verdict.sum() + 1)))
        k = len(names)
        return Chain(names, {}, np.zeros((0, k)), np.zeros((k, k)), np.full(k, b), 2.0)
    rows = np.repeat(np.arange(n), [len(g) for g in got])
    idx = np.array([i for g in got for i in sorted(g)], np.int64)
    fold = np.random.default_rng(p["seed"]).permutation(n) % p["folds"]
    k = len(index)
    words, earlier, bias = np.zeros((k, len(names))), np.zeros((len(names), len(names))), np.zeros(len(names))
    oof = np.zeros((n, len(names)))
    for j, name in enumerate(names):
        y, extra = labels[name].astype(float), oof[:, :j]
        if 0 < y.sum() < n:
            for f in range(p["folds"]):
                own = fold != f
                at = np.cumsum(own) - 1
                keep = own[rows]
                w, v, b = _fit(idx[keep], at[rows[keep]], int(own.sum()), extra[own], y[own], k, p["l2"], p["steps"])
                z = np.bincount(rows, w[idx], minlength=n) + extra @ v + b
                oof[~own, j] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[~own]
            words[:, j], earlier[j, :j], bias[j] = _fit(idx, rows, n, extra, y, k, p["l2"], p["steps"])
        else:
            bias[j] = np.log((y.sum() + 1) / (n - y.sum() + 1))
            oof[:, j] = 1 / (1 + np.exp(-bias[j]))
    return Chain(names, index, words, earlier, bias, best_threshold(oof[:, -1], verdict, p["least_f1"]))


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """The middle of the gap at which F1 is best; above all probabilities if F1 is less than the least."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # only between different scores
    at = int(np.argmax(np.where(last, f1, -1)))
    if f1[at] < least:
        return 2.0
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(y) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", categories: list[str] | None = None, **params) -> Chain:
    """A chain from labelled documents; categories: further 0/1 columns of labels ahead of label_col, else those of SEEDS."""
    p = PARAMS | params
    named = categories or []
    cols = [*named, label_col]
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = known.groupBy(F.col(id_col).alias("_id")).agg(*[F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")).alias(f"_y{i}") for i, c in enumerate(cols)])
    verdict = F.col(f"_y{len(cols) - 1}") > 0
    order = F.xxhash64(F.lit(p["seed"]), "_id")
    sample = one.where(verdict).orderBy(order, "_id").limit(p["max_positive"]).unionByName(one.where(~verdict).orderBy(order, "_id").limit(p["max_negative"]))
    # At most max_positive + max_negative rows of a few numbers, so they go to the documents.
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")
    seeds = {} if named else {c: {w.encode() for w in s.split()} for c, s in SEEDS.items()}

    def found(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [features(t) for t in as_bytes(b, "_t")]
        ys = [b.column(f"_y{i}") for i in range(len(cols))]
        seeded = [pa.array([int(y and not s.isdisjoint(x)) for x, y in zip(f, ys[-1].to_pylist())], pa.int32()) for s in seeds.values()]
        return pa.RecordBatch.from_arrays([b.column(b.schema.names.index("_id")), *seeded, *ys, pa.array([sorted(x) for x in f], pa.list_(pa.binary()))], names=["_id", *every, "f"])

    every = [f"_s{i}" for i in range(len(seeds))] + [f"_y{i}" for i in range(len(cols))]
    ints = ", ".join(f"{c} int" for c in every)
    seen = stored(map_docs(joined, joined.columns, found, f"_id long, {ints}, f array<binary>").groupBy("_id").agg(F.min(F.struct("f", *every)).alias("x")).select("_id", "x.*"))
    n, n1 = seen.agg(F.count("*"), F.coalesce(F.sum(every[-1]), F.lit(0))).first()
    want = F.col("c") * (max(1, n1) / max(1, n))
    off = (F.col("a") - want) ** 2
    counts = seen.select(every[-1], F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum(every[-1]).alias("a")).where("c >= 3")
    best = counts.orderBy((off / (want + 1e-9) + off / (F.col("c") - want + 1e-9)).desc(), "f").limit(_width(n, p)).select("f").collect()
    index = {bytes(r.f): i for i, r in enumerate(best)}

    def numbered(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [[index[f] for f in fs if f in index] for fs in b.column("f").to_pylist()]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", *every)), pa.array(got, pa.list_(pa.int32()))], names=["_id", *every, "i"])

    rows = map_docs(seen, ["_id", *every, "f"], numbered, f"_id long, {ints}, i array<int>").toArrow().sort_by("_id")
    labelled = {c: rows.column(e).to_numpy() > 0 for c, e in zip([*seeds, *cols], every)}
    return fit_links(rows.column("i").to_pylist(), index, labelled, **params)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability per category (p_<category>) and rejected. No shuffle."""
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.names) + ", rejected boolean"

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.array([chain.score(t) for t in as_bytes(b, text_col)]).reshape(-1, len(chain.names))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, j]) for j in range(p.shape[1])], pa.array(p[:, -1] >= chain.threshold)], names=[x.split()[0] for x in schema.split(", ")])

    return map_docs(docs, [id_col, text_col], each, schema)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs that the chain doesn't reject, whole rows, in one pass."""

    def run(it):
        for b in it:
            if b.num_rows:
                keep = [chain.score(t)[-1] < chain.threshold for t in as_bytes(b, text_col)]
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents: a row each, repeated rows too. Null and empty texts are scored like any; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_classifier_chain": op8_classifier_chain}
SQL: dict[str, str] = {}
