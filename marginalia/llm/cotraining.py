"""Quality classifier by co-training of two views.

One view sees what the text contains (lengths, symbols, repetition, common words, ...), the other what the page is (language,
source, stated length). Each is a logistic model over binned features. In every round each view, fitted and calibrated,
pseudo-labels the unlabelled documents that it is surest of, in the proportion of the labels and, in all, `per_round` of the labelled training
documents' number; these join the training set of the other view. A view is sure of a label if it is at most `sure` times as likely to be wrong
as someone who knows but the classes' shares. At the end each view is calibrated by
Platt scaling on held-out labelled documents, a logistic model over both calibrated logits combines them, and the threshold is
the highest that keeps `keep_recall` of held-out good documents, but no higher than `highest`.

Models are fitted on at most `max_labelled` labelled documents of each class, those of least hash of the id. The pool is all
unlabelled documents with an id: both views are measured once and written, every round goes over all of them, and what it gathers is bounded by
`per_round`. The scores come from the same table, without a shuffle.

Nulls: a null text is an empty one, a null language, source or length a value of its own. Null labels or ids don't count for
training; of several labels of a document the largest counts, of several rows of an id one. With fewer than `min_class` labels of either class,
every score is the smoothed share of good labels and all documents are kept. Empty tables give empty results, repeated rows repeated ones; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_str, map_docs, stored, table
from .quality_rules import SYMBOLS, measure

PARAMS = {"max_labelled": 5000, "min_class": 6, "rounds": 4, "per_round": 0.15, "sure": 0.5, "bins": 12, "l2": 1.0, "keep_recall": 0.9995, "highest": 0.1, "seed": 1}
SOURCE_BINS, LANG_BINS = 64, 16
CONTENT = ("log_words", "word_length", "symbols", "repeats", "dup_lines", "common", "capitals", "digits", "stops", "lines", "spaces", "marks")


def content(text: str) -> list[float]:
    """The text view's numbers (CONTENT) of a whole text."""
    n, word_chars, symbols, dup, rep, chars, hist = measure(text)
    size, words, lines = max(1, len(text)), max(1, n), text.count("\n") + 1
    return [np.log1p(n), word_chars / words, symbols / size, rep / words, dup / lines, 1 - hist[-1] / words, chars[0] / size, chars[1] / size, chars[4] / words, lines / words, chars[2] / size, (chars[5] + chars[SYMBOLS + 1]) / size]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """The page view's numbers: places of language and source, and the log of the stated length (-1: none)."""
    place = lambda x, n: float(n if x is None else zlib.crc32(x.encode()) % n)
    return [place(lang, LANG_BINS), place(source, SOURCE_BINS), float(np.log1p(max(0, n_chars))) if n_chars is not None else -1.0]


@dataclass
class Binner:
    """One-hot bins of numbers by quantile edges, or of places as they are."""

    edges: list[np.ndarray | int]

    @staticmethod
    def fit(x: np.ndarray, bins: int, places: tuple[int, ...] = ()) -> "Binner":
        out: list[np.ndarray | int] = list(places)
        for j in range(len(places), x.shape[1]):
            out.append(np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) if len(x) else np.zeros(0))
        return Binner(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = []
        for j, e in enumerate(self.edges):
            k = e + 1 if isinstance(e, int) else len(e) + 1
            at = x[:, j].astype(int) if isinstance(e, int) else np.searchsorted(e, x[:, j], side="right")
            out.append(np.eye(k)[at])
        return np.concatenate(out, 1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 15) -> np.ndarray:
    """Weights, the bias last, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), g)
        w -= step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class View:
    bins: Binner
    weights: np.ndarray
    scale: np.ndarray  # Platt: slope, offset

    def logit(self, x: np.ndarray) -> np.ndarray:
        return logits(logits(self.bins(x), self.weights)[:, None], self.scale)


@dataclass
class Model:
    views: list[View]
    combine: np.ndarray
    threshold: float
    exchanged: list[tuple[int, int]]  # pseudo-labels that each view gave, by round

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of their combination."""
        z = [v.logit(x) for v, x in zip(self.views, views)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(logits(np.stack(z, 1), self.combine))


def cotrain(labelled: list[np.ndarray], y: np.ndarray, surest: Callable, **params) -> Model:
    """labelled: the rows of each view. A third of them is held out for calibration.

    surest(probs, asks, taken): for each ask (view, label, n, least probability) the rows of both views of the n unlabelled documents, not in
    taken[view], whose label is surest by probs[view], and their ids.
    """
    p = PARAMS | params
    held = np.random.default_rng(p["seed"]).permutation(len(y)) % 3 == 0
    bins = [Binner.fit(labelled[0], p["bins"]), Binner.fit(labelled[1], p["bins"], (LANG_BINS, SOURCE_BINS))]
    kept = [b(x[held]) for b, x in zip(bins, labelled)]
    train = [b(x[~held]) for b, x in zip(bins, labelled)]
    target = [y[~held].astype(float)] * 2
    share, n = y[~held].mean(), p["per_round"] * len(train[0])
    taken: list[set] = [set(), set()]  # what each view has given
    exchanged: list[tuple[int, int]] = []

    def fit() -> list[View]:
        out = []
        for b, x, t, k in zip(bins, train, target, kept):
            w = logistic(x, t, p["l2"])
            out.append(View(b, w, logistic(logits(k, w)[:, None], y[held].astype(float), 1e-3)))
        return out

    for _ in range(p["rounds"]):
        asks = [(v, label, round(n * part), 1 - p["sure"] * (1 - part)) for v in range(2) for label, part in ((1, share), (0, 1 - share))]
        found = surest(fit(), asks, taken)
        given = [0, 0]
        for (v, label, _, _), (ids, rows) in zip(asks, found):
            if ids:
                taken[v] |= set(ids)
                train[1 - v] = np.concatenate([train[1 - v], bins[1 - v](rows[1 - v])])
                target[1 - v] = np.concatenate([target[1 - v], np.full(len(ids), float(label))])
                given[v] += len(ids)
        exchanged.append((given[0], given[1]))
        if not any(given):
            break
    views = fit()
    z = np.stack([v.logit(x[held]) for v, x in zip(views, labelled)], 1)
    combine = logistic(z, y[held].astype(float), 1.0)
    good = np.sort(sigmoid(logits(z, combine))[y[held] > 0])
    lowest = good[int((1 - p["keep_recall"]) * len(good))] if len(good) else 0.0
    return Model(views, combine, float(min(p["highest"], lowest)), exchanged)


def constant(share: float) -> Model:
    z = float(np.log(share / (1 - share)))
    bins = [Binner([np.zeros(0)] * len(CONTENT)), Binner([LANG_BINS, SOURCE_BINS, np.zeros(0)])]
    views = [View(b, np.zeros(b(np.zeros((1, len(b.edges)))).shape[1] + 1), np.array([0.0, z])) for b in bins]
    return Model(views, np.array([0.5, 0.5, 0.0]), 0.0, [])


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(b: pa.RecordBatch) -> tuple[list[list[float]], list[list[float]]]:
    text = [content(t) for t in as_str(b, "text")]
    meta = [metadata(*x) for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist())]
    return text, meta


def _named(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns doc_id, text, lang, source and n_chars, from those named; a name of None gives nulls."""
    kinds = dict(zip(COLUMNS, ("long", "string", "string", "string", "long")))
    return docs.select(*[(F.lit(None) if n is None else F.col(n)).cast(kinds[c]).alias(c) for c, n in zip(COLUMNS, names)])


MEASURED = "doc_id long, o long, c array<double>, m array<double>"


def measured(docs: DataFrame, names: tuple[str, ...] = COLUMNS, seed: int = PARAMS["seed"]) -> DataFrame:
    """Both views' numbers of every document: doc_id, o (a hash that orders ids), c, m. No shuffle."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.float64())
        text, meta = _rows(b)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("o"), pa.array(text, kind), pa.array(meta, kind)], names=["doc_id", "o", "c", "m"])

    return map_docs(_named(docs, names).withColumn("o", F.xxhash64(F.lit(seed), "doc_id")), [*COLUMNS, "o"], each, MEASURED)


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("c", len(CONTENT)), ("m", 3))]


def pool_of(rest: DataFrame) -> Callable:
    """The surest() of cotrain() over a stored table of unlabelled documents; of each batch only its own surest rows go on."""

    def surest(views: list[View], asks: list[tuple], taken: list[set]) -> list[tuple]:
        def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, ids, o = _views(b), b.column("doc_id").to_pylist(), b.column("o").to_pylist()
                prob = [sigmoid(v.logit(rows)) for v, rows in zip(views, x)] if len(ids) else []
                for k, (v, label, n, least) in enumerate(asks if len(ids) else []):
                    sure = np.round(prob[v] if label else 1 - prob[v], 9)
                    some = [i for i in np.nonzero(sure >= least)[0] if ids[i] not in taken[v]]
                    one: dict[int, int] = {}
                    for i in sorted(some, key=lambda i: (-sure[i], o[i], ids[i])):
                        one.setdefault(ids[i], i)
                        if len(one) == n:
                            break
                    at = pa.array(list(one.values()), pa.int64())
                    out = b.take(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(sure[at.to_numpy()]), *out.columns], names=["ask", "sure", "doc_id", "o", "c", "m"])

        found = stored(rest.mapInArrow(best, f"ask int, sure double, {MEASURED}").groupBy("ask", "doc_id").agg(F.max(F.struct("sure", "o", "c", "m")).alias("x")).select("ask", "doc_id", "x.*"))
        out = []
        for k, (_, _, n, _) in enumerate(asks):
            rows = found.where(F.col("ask") == k).orderBy(F.desc("sure"), "o", "doc_id").limit(n).collect()
            out.append(([r.doc_id for r in rows], [np.array([r[c] for r in rows], float) for c in ("c", "m")]))
        return out

    return surest


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality", **params) -> Model:
    """A model from measured() documents, stored, and labels."""
    p = PARAMS | params
    known = stored(labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")))
    order = F.xxhash64(F.lit(p["seed"]), "doc_id")
    sample = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(p["max_labelled"]) for y in (1, 0)]
    # At most 2 * max_labelled ids, so they go to the documents; one row an id comes back.
    own = found.join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", "c", "m")).alias("x")).select("doc_id", "x.*").collect()
    own = sorted(own, key=lambda r: r.doc_id)
    y = np.array([r.y for r in own], int)
    if len(y) == 0 or min(y.sum(), len(y) - y.sum()) < p["min_class"]:
        return constant((y.sum() + 1) / (len(y) + 2))
    rest = stored(found.where(F.col("doc_id").isNotNull()).join(known.select("doc_id"), "doc_id", "left_anti"))
    return cotrain([np.array([r[c] for r in own], float) for c in ("c", "m")], y, pool_of(rest), **params)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", names: tuple[str, ...] = COLUMNS, **params) -> Model:
    return fit(stored(measured(docs, names, (PARAMS | params)["seed"])), labels, label_col, **params)


SCORES = "doc_id long, p_content double, p_metadata double, score double, kept boolean"


def judged(found: DataFrame, model: Model) -> DataFrame:
    """Of measured() documents the calibrated probability of being good, by view and combined, and whether each is kept."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        a, m, both = model.score(_views(b))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a), pa.array(m), pa.array(both), pa.array(both >= model.threshold)], names=[x.split()[0] for x in SCORES.split(", ")])

    return map_docs(found, ["doc_id", "c", "m"], each, SCORES)


def score(docs: DataFrame, model: Model, names: tuple[str, ...] = COLUMNS) -> DataFrame:
    """judged() for documents, in one pass."""
    return judged(measured(docs, names), model)


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents: a row each, repeated rows too. Null and empty texts are scored like any; without enough labels all get the labels'
    share; an empty table gives no rows."""
    found = stored(measured(table(spark, sf_dir, "documents")))
    return judged(found, fit(found, table(spark, sf_dir, "labels")))


QUERIES = {"op1_cotraining_quality": op1_cotraining_quality}
SQL: dict[str, str] = {}
