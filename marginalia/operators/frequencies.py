"""Corpus statistics: n-gram counts and probabilities, log-likelihood ratios, spelling shift and co-occurrence.

Counts are sums of partial counts, so a word that makes up a third of a corpus costs a row a task or block of texts. Tables of
counts join on their keys. Texts come as a column of token arrays; null arrays have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.sources.shared import gathered, stored

START, END = "<s>", "</s>"
EPSILON, ABSENT = 1e-20, 1e4


def words(text: str | Column, lower: bool = True) -> Column:
    """A text's words as an array; letters, digits and underscores make words."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_ngrams(tokens: str | Column, n: int) -> Column:
    """Word n-grams, joined by spaces, of the tokens with n-1 marks before and after them."""
    if n <= 0:
        raise ValueError("n must be positive")
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    if n == 1:
        return t
    full = F.concat(F.array_repeat(F.lit(START), n - 1), t, F.array_repeat(F.lit(END), n - 1))
    # One n-gram per place: the words of n shifted copies of the array, side by side.
    size = F.size(full) - n + 1
    shifted = [F.slice(full, k + 1, size) for k in range(n)]
    joined = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), shifted)
    return F.when(size > 0, joined).otherwise(F.array().cast("array<string>"))


def ngram_head(ngram: str | Column) -> Column:
    """All but the last word of an n-gram."""
    return F.regexp_replace(F.col(ngram) if isinstance(ngram, str) else ngram, r" ?[^ ]*$", "")


#: Tokens that a task numbers and counts at a time, ahead of any shuffle; it holds no more of them, but for a longer text.
BLOCK = 1 << 20


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Tokens of several texts side by side, about BLOCK of them, and how many each text has. Texts stay whole."""
    held, size = [], 0

    def block() -> tuple[pa.Array, np.ndarray]:
        lists = pa.concat_arrays(held)
        return lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)

    for b in it:
        lists, at = b.column(0), 0
        ends = lists.offsets.to_numpy()
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK - size, "right")) - 1)
            held.append(lists.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
            if size >= BLOCK or at < len(lists):
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _rows(*columns: pa.Array, names: list[str], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(list(columns), names=names)
    return (batch.slice(at, most) for at in range(0, batch.num_rows, most))


def _ngram_rows(most: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sizes in _blocks(it):
            coded = tokens.dictionary_encode("encode")
            words, d, pad = pa.concat_arrays([coded.dictionary, pa.array([START, END], coded.dictionary.type)]), len(coded.dictionary) + 2, most - 1
            # Each text with most - 1 marks around it; windows of two texts are numbered, too, but not counted.
            long = sizes + 2 * pad
            starts = np.cumsum(long) - long
            word = np.full(int(long.sum()), d - 2, np.int64)
            word[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)) * 2 * pad + pad, sizes)] = coded.indices.to_numpy()
            for k in range(pad):
                word[starts + long - 1 - k] = d - 1
            place = np.arange(len(word)) - np.repeat(starts, long)
            inside = place <= np.repeat(long, long) - most
            code, gram = word, words
            for n in range(1, most + 1):
                if n > 1:
                    pairs = pa.array(code[:-1] * d + word[n - 1 :]).dictionary_encode()
                    code, key = pairs.indices.to_numpy().astype(np.int64), pairs.dictionary.to_numpy()
                counts = np.bincount(code[inside[: len(code)] & (place[: len(code)] >= most - n)], minlength=len(key) if n > 1 else d)
                seen = np.flatnonzero(counts)
                if n > 1:
                    join = lambda k: pc.binary_join_element_wise(gram.take(pa.array(k // d)), words.take(pa.array(k % d)), " ")  # noqa: B023, E731
                    if n == most:
                        found = join(key[seen])
                    else:
                        gram = join(key)
                if n == 1 or n < most:
                    found = gram.take(pa.array(seen))
                yield from _rows(pa.array(np.full(len(seen), n, np.int32)), found, pa.array(counts[seen]), names=["n", "ngram", "freq"])

    return run


def count_ngrams(docs: DataFrame, tokens: str, most: int) -> DataFrame:
    """n, ngram, freq for n = 1 .. most; one scan, one shuffle.

    Tasks number the tokens of a block of texts and count numbers, so that only what differs within a block becomes strings and is shuffled.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    own = docs.where(F.col(tokens).isNotNull()).select(F.col(tokens).alias("t"))
    return gathered(own.mapInArrow(_ngram_rows(most), "n int, ngram string, freq long"), own, "n", "ngram").groupBy("n", "ngram").agg(F.sum("freq").alias("freq"))


def totals(ngrams: DataFrame) -> DataFrame:
    """n, total_tokens, total_types."""
    return ngrams.groupBy("n").agg(F.sum("freq").alias("total_tokens"), F.count("*").alias("total_types"))


def _known(ngrams: DataFrame, asked: DataFrame, col: str, name: str, docs: int | None = None) -> DataFrame:
    """asked with the frequency of a column's n-grams; marks alone count as documents where their number is given."""
    table = ngrams.select(F.col("ngram").alias("_g"), F.col("freq").alias("_f"))
    out = asked.join(table, F.col(col) == F.col("_g"), "left")
    freq = F.coalesce("_f", F.lit(0))
    if docs is not None:
        freq = F.when(F.col(col).rlike(rf"^{START}( {START})*$|^{END}( {END})*$"), F.lit(docs)).otherwise(freq)
    return out.withColumn(name, freq.cast("long")).drop("_g", "_f")


def frequencies(ngrams: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ngram) with freq, 0 where unseen; asked that has freq is left as it is."""
    return asked if "freq" in asked.columns else _known(ngrams, asked, "ngram", "freq")


def probabilities(ngrams: DataFrame, asked: DataFrame, smoothing: str | None = None) -> DataFrame:
    """asked (ngram, and freq where it is known, which saves a join) with prob: relative frequency among n-grams of its order, or with one added to each type's count."""
    if smoothing not in (None, "laplace"):
        raise ValueError("smoothing is None or 'laplace'")
    t = F.broadcast(totals(ngrams))  # a row per order
    out = frequencies(ngrams, asked).withColumn("n", F.size(F.split("ngram", " "))).join(t, "n", "left")
    if smoothing is None:
        return out.withColumn("prob", F.col("freq") / F.col("total_tokens")).drop("total_tokens", "total_types")
    vocab = t.where("n = 1").select(F.col("total_types").alias("_v"))
    out = out.join(vocab, F.lit(True), "left")
    return out.withColumn("prob", (F.col("freq") + 1) / (F.col("total_tokens") + F.col("_v"))).drop("total_tokens", "total_types", "_v")


def conditional_probabilities(ngrams: DataFrame, asked: DataFrame, docs: int, smoothing: str | None = None, lambdas: list[float] | None = None, k: float = 1.0) -> DataFrame:
    """asked (ngram) with prob of the last word given those before it: plain, with k added, or interpolated over orders.

    lambdas weigh the orders from the whole n-gram down to its last word; a sum of 0 becomes one over the number of tokens.
    docs: the number of documents, which marks alone count as.
    """
    if smoothing not in (None, "laplace", "interpolation"):
        raise ValueError("smoothing is None, 'laplace' or 'interpolation'")
    one = ngrams.where("n = 1").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("_t"), F.count("*").alias("_v"))

    def conditional(df: DataFrame, col: str, name: str, add: float) -> DataFrame:
        df = df.withColumn("_head", ngram_head(col))
        df = _known(ngrams, df, col, "_f1", docs)
        df = _known(ngrams, df, "_head", "_f2", docs)
        head = F.when(F.col("_head") == "", F.col("_t")).otherwise(F.col("_f2"))
        value = F.when(head > 0, (F.col("_f1") + add) / (head + add * F.col("_v"))).otherwise(F.lit(0.0))
        return df.withColumn(name, value).drop("_head", "_f1", "_f2")

    df = asked.join(one, F.lit(True))
    if smoothing != "interpolation":
        return conditional(df, "ngram", "prob", k if smoothing == "laplace" else 0.0).drop("_t", "_v")
    check_lambdas(lambdas)
    for i in range(len(lambdas)):
        tail = F.array_join(F.slice(F.split("ngram", " "), F.least(F.lit(i + 1), F.size(F.split("ngram", " "))), F.size(F.split("ngram", " "))), " ")
        df = conditional(df.withColumn("_tail", tail), "_tail", f"_p{i}", 0.0).drop("_tail")
    total = sum((F.lit(x) * F.col(f"_p{i}") for i, x in enumerate(lambdas)), F.lit(0.0))
    return df.withColumn("prob", F.when(total == 0, 1 / F.col("_t")).otherwise(total)).drop("_t", "_v", *[f"_p{i}" for i in range(len(lambdas))])


def counted_conditionals(ngrams: DataFrame, order: int, docs: int, smoothing: str | None = None, lambdas: list[float] | None = None, k: float = 1.0) -> DataFrame:
    """ngram, prob of every counted n-gram of an order, as conditional_probabilities() has it. ngrams: counts of words, without spaces, up to that order.

    Counts are in the table already. An order is joined with the one below alone: for its heads, and for what its tails have at all lower orders.
    """
    if smoothing not in (None, "laplace", "interpolation"):
        raise ValueError("smoothing is None, 'laplace' or 'interpolation'")
    if order < 2:
        raise ValueError("order must be 2 or more")
    one = ngrams.where("n = 1").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("_t"), F.count("*").alias("_v"))
    of = lambda n: ngrams.where(F.col("n") == n).select("ngram", "freq")

    def with_head(df: DataFrame, n: int) -> DataFrame:
        """df with _h: the frequency of the n-gram's head, by a join."""
        heads = of(n - 1).select(F.col("ngram").alias("_g"), F.col("freq").alias("_f"))
        df = df.withColumn("_head", F.substring_index("ngram", " ", n - 1)).join(heads, F.col("_head") == F.col("_g"), "left")
        marks = F.col("_head").isin(" ".join([START] * (n - 1)), " ".join([END] * (n - 1)))
        return df.withColumn("_h", F.when(marks, F.lit(docs)).otherwise(F.coalesce("_f", F.lit(0)))).drop("_head", "_g", "_f")

    ratio = lambda add: F.when(F.col("_h") > 0, (F.col("freq") + add) / (F.col("_h") + add * F.col("_v"))).otherwise(F.lit(0.0))
    if smoothing != "interpolation":
        df = with_head(of(order), order).crossJoin(F.broadcast(one))
        return df.select("ngram", ratio(k if smoothing == "laplace" else 0.0).alias("prob"))
    check_lambdas(lambdas, order)
    share = lambda freq: F.when(F.col("_t") > 0, freq / F.col("_t")).otherwise(F.lit(0.0))
    # _p: an n-gram's probability at its own order and all lower ones. Closing marks alone are no n-grams, but tails.
    level = of(1).crossJoin(F.broadcast(one)).select("ngram", F.array(share(F.col("freq"))).alias("_p"))
    spark = ngrams.sparkSession
    closing = spark.range(1).crossJoin(F.broadcast(one)).select(F.lit(END).alias("ngram"), F.array(share(F.lit(docs))).alias("_p"))
    certain = F.lit(1.0 if docs > 0 else 0.0)
    for n in range(2, order + 1):
        tails = level.unionByName(closing).select(F.col("ngram").alias("_tail"), F.col("_p").alias("_q"))
        df = with_head(of(n).withColumn("_tail", F.substring_index("ngram", " ", 1 - n)), n).join(tails, "_tail")
        level = df.select("ngram", F.concat(F.array(F.when(F.col("_h") > 0, F.col("freq") / F.col("_h")).otherwise(F.lit(0.0))), F.col("_q")).alias("_p"))
        closing = closing.select(F.concat("ngram", F.lit(f" {END}")).alias("ngram"), F.concat(F.array(certain), "_p").alias("_p"))
        if n < order:
            level = stored(level)
    total = sum((F.lit(x) * F.col("_p")[i] for i, x in enumerate(lambdas)), F.lit(0.0))
    return level.crossJoin(F.broadcast(one)).select("ngram", F.when(total == 0, 1 / F.col("_t")).otherwise(total).alias("prob"))


def check_lambdas(lambdas: list[float] | None, n: int | None = None) -> None:
    if not lambdas or n is not None and len(lambdas) != n or any(x < 0 for x in lambdas) or abs(sum(lambdas) - 1) > 1e-9:
        raise ValueError("lambdas must be weights of 0 or more, one an order, with sum 1")


# --- two corpora ---


def both(target: DataFrame, reference: DataFrame, key: str = "token") -> DataFrame:
    """key, f1, f2, t1, t2: frequencies (freq) in two corpora, 0 where absent, and the corpora's totals."""
    a = target.select(F.col(key), F.col("freq").alias("f1"))
    b = reference.select(F.col(key), F.col("freq").alias("f2"))
    t = target.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("t1")).join(reference.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("t2")), F.lit(True))
    joined = a.join(b, key, "full").select(key, F.coalesce("f1", F.lit(0)).alias("f1"), F.coalesce("f2", F.lit(0)).alias("f2"))
    return joined.join(F.broadcast(t), F.lit(True))  # one row


def llr(f1: Column, f2: Column, t1: Column, t2: Column) -> Column:
    """Log-likelihood ratio (G2) of a word's frequencies in two corpora."""
    n = t1 + t2
    cells = [(f1, (f1 + f2) * t1 / n), (f2, (f1 + f2) * t2 / n), (t1 - f1, (n - f1 - f2) * t1 / n), (t2 - f2, (n - f1 - f2) * t2 / n)]
    return 2 * reduce(lambda a, b: a + b, [o * F.log((o + EPSILON) / (e + EPSILON)) for o, e in cells])


def compare(target: DataFrame, reference: DataFrame, key: str = "token") -> DataFrame:
    """key, f1, f2, llr, direction (more or less than expected in the target), diff (relative; infinite where not in the reference)."""
    c = [F.col(x).cast("double") for x in ("f1", "f2", "t1", "t2")]
    more = c[0] > (c[0] + c[1]) * c[2] / (c[2] + c[3])
    diff = F.when(c[1] == 0, F.lit(float("inf"))).otherwise((c[0] / c[2] - c[1] / c[3]) / (c[1] / c[3]))
    return both(target, reference, key).select(key, "f1", "f2", llr(*c).alias("llr"), F.when(more, "more").otherwise("less").alias("direction"), diff.alias("diff"))


def spelling_diff(first: DataFrame, second: DataFrame, key: str = "token") -> DataFrame:
    """Per word: frequencies and fractions in both corpora, relative differences both ways (a large number where the other
    corpus lacks the word), llr and direction."""
    c = [F.col(x).cast("double") for x in ("f1", "f2", "t1", "t2")]
    x, y = c[0] / c[2], c[1] / c[3]
    d1 = F.when(c[1] == 0, F.lit(ABSENT)).otherwise((x - y) / y)
    d2 = F.when(c[0] == 0, F.lit(ABSENT)).otherwise((y - x) / x)
    more = c[0] > (c[0] + c[1]) * c[2] / (c[2] + c[3])
    return both(first, second, key).select(
        key, "f1", x.alias("frac1"), d1.alias("perc_diff1"), "f2", y.alias("frac2"), d2.alias("perc_diff2"), llr(*c).alias("llr"), F.when(more, "more").otherwise("less").alias("direction")
    )


def frequent_words(diff: DataFrame, min_freq: int | None = None, min_frac: float | None = None, key: str = "token") -> DataFrame:
    """Words at or above a frequency, or a fraction, in either corpus."""
    if min_freq:
        return diff.where((F.col("f1") >= min_freq) | (F.col("f2") >= min_freq)).select(key)
    if min_frac:
        return diff.where((F.col("frac1") >= min_frac) | (F.col("frac2") >= min_frac)).select(key)
    raise ValueError("give min_freq or min_frac")


def change_levels(diff: DataFrame, increase: float = 0.5, emerge: float = 5.0, decrease: float = 0.5, disappear: float = 5.0) -> DataFrame:
    """diff with level: disappear, decrease, emerge or increase; words without change are left out."""
    if emerge < increase or disappear < decrease:
        raise ValueError("emerge and disappear must be at least increase and decrease")
    level = F.when(F.col("perc_diff1") > disappear, "disappear").when(F.col("perc_diff1") > decrease, "decrease").when(F.col("perc_diff2") > emerge, "emerge").when(F.col("perc_diff2") > increase, "increase")
    return diff.withColumn("level", level).where("level is not null")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def linked_changes(levels: DataFrame, vectors: DataFrame, similarity: float = 0.6, key: str = "token", block: int = 4096) -> DataFrame:
    """drop, jump, drop_level, jump_level, change: words that went down with words of similar vectors that went up (replace
    if it disappeared, else shift), and the rest of both alone.

    Words that went down are queries against all that went up, `block` of them at a time: a block's vectors go to the tasks, which compare by matrix
    products, and its links are written before the next block. Words without a vector have no links. vectors: key, vector.
    """
    v = levels.join(vectors.select(key, F.col("vector").cast("array<double>").alias("vector")), key, "left")
    down = stored(v.where(F.col("level").isin("disappear", "decrease")).select(F.col(key).alias("drop"), F.col("level").alias("drop_level"), "vector"))
    up = stored(v.where(F.col("level").isin("emerge", "increase")).select(F.col(key).alias("jump"), F.col("level").alias("jump_level"), "vector"))
    some = down.where("vector is not null")
    parts, found = max(1, -(-2 * some.count() // block)), []

    def compare_with(names: list[str], unit: np.ndarray) -> Callable:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    own = np.array(b.column(1).to_pylist(), float)
                    hit = np.argwhere(unit @ (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)).T > similarity)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hit[:, 0]], pa.string()), b.column(0).take(pa.array(hit[:, 1]))], names=["drop", "jump"])

        return run

    for k in range(parts):
        rows = some.where(F.pmod(F.xxhash64("drop"), F.lit(parts)) == k).select("drop", "vector").collect()  # about half a block
        if rows:
            x = np.array([r.vector for r in rows], float)
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            found.append(stored(up.where("vector is not null").select("jump", "vector").mapInArrow(compare_with([r["drop"] for r in rows], unit), "drop string, jump string")))
    linked = reduce(DataFrame.unionByName, found) if found else down.join(up, F.lit(False)).select("drop", "jump")
    linked = linked.join(down.drop("vector"), "drop").join(up.drop("vector"), "jump")
    linked = linked.select("drop", "jump", "drop_level", "jump_level", F.when(F.col("drop_level") == "disappear", "replace").otherwise("shift").alias("change"))
    none = F.lit(None).cast("string")
    lone_down = down.join(linked, "drop", "left_anti").select("drop", none.alias("jump"), "drop_level", none.alias("jump_level"), F.col("drop_level").alias("change"))
    lone_up = up.join(linked, "jump", "left_anti").select(none.alias("drop"), "jump", none.alias("drop_level"), "jump_level", F.col("jump_level").alias("change"))
    return linked.unionByName(lone_down).unionByName(lone_up)


# --- co-occurrence ---


def _pair_rows(skip: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sizes in _blocks(it):
            coded = tokens.dictionary_encode("encode")
            words, d = coded.dictionary, len(coded.dictionary)
            word, text = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            near = [(word[:-k] * d + word[k:])[text[:-k] == text[k:]] for k in range(1, skip + 2)]
            pairs = pa.array(np.concatenate(near)).dictionary_encode()
            key = pairs.dictionary.to_numpy()
            freq = np.bincount(pairs.indices.to_numpy(), minlength=len(key))
            yield from _rows(words.take(pa.array(key // max(d, 1))), words.take(pa.array(key % max(d, 1))), pa.array(freq), names=["term1", "term2", "freq"])

    return run


def cooccurrences(docs: DataFrame, tokens: str, skip: int = 1) -> DataFrame:
    """term1, term2, freq of ordered pairs at most skip words apart. Pairs come from shifted copies of each array: no join.

    Tasks count a block of texts at a time, so their memory doesn't grow with the table.
    """
    if skip < 0:
        raise ValueError("skip must be zero or more")
    own = docs.where(F.col(tokens).isNotNull()).select(F.col(tokens).alias("t"))
    return gathered(own.mapInArrow(_pair_rows(skip), "term1 string, term2 string, freq long"), own, "term1", "term2").groupBy("term1", "term2").agg(F.sum("freq").alias("freq"))


def cooccurring(coocs: DataFrame, term: str) -> DataFrame:
    """term2, freq of the words that follow a term."""
    return coocs.where(F.col("term1") == term).select("term2", "freq")
