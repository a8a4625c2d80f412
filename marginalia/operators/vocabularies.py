"""Vocabularies, near-duplicate keywords, skipgram similarity and byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.sources.shared import stored


def vocabulary(terms: DataFrame, term: str = "term", order: str | None = None, ignorecase: bool = False) -> DataFrame:
    """term, id: distinct terms numbered from 0 by first place (order), or by term.

    Numbers come from range-sorted partitions and their sizes, so no task sees all terms.
    """
    t = F.lower(term) if ignorecase else F.col(term)
    first = terms.where(F.col(term).isNotNull()).groupBy(t.alias("term")).agg(F.min(order).alias("_o") if order else F.lit(0).alias("_o"))
    ranged = stored(first.repartitionByRange("_o", "term").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").count()  # a row a partition
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_o", "term")) - 1
    return ranged.join(F.broadcast(before), "_p").select("term", (rank + F.col("_b")).cast("long").alias("id"))


# --- near-duplicate keywords ---


def close_keywords(keywords: DataFrame, keyword: str = "keyword", max_distance: int = 3, max_ratio: float = 0.3) -> DataFrame:
    """a, b, distance for every unordered pair of distinct keywords that columns.close_distance accepts.

    The longer keyword's length bounds the changes of a pair: fewer than max_distance, and than max_ratio of that length. Up to two changes two
    keywords have a string in common that is left of each when as many characters are deleted, so they meet in an equi-join on such strings, of which a
    keyword has about half its length squared. k changes, if more, touch at most
    k of k + 1 parts of the shorter keyword, so one part stands whole in the longer, at most k places off, and pairs meet in an equi-join
    on both lengths, part and text of it. Either way no pair is lost, and each distance is computed up to its bound.
    """
    if max_distance < 1:
        raise ValueError("max_distance must be positive")
    words = keywords.where(F.col(keyword).isNotNull() & (F.col(keyword) != "")).select(F.col(keyword).alias("w")).distinct()
    changes = lambda longer: F.least(F.lit(max_distance - 1), F.ceil(longer * max_ratio + 1e-9).cast("int"))
    if max_distance <= 3:
        one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        # Of a keyword as many characters go as its own pairs need: with one longer by g characters g fewer than changes. None is k = 0, no pair is null.
        fewer = lambda longer: F.least(F.lit(max_distance - 1), F.ceil(longer * max_ratio + 1e-9).cast("int") - 1)
        need = [F.when(fewer(F.col("n") + g) >= max(g, 1), fewer(F.col("n") + g) - g) for g in range(max_distance)]
        most = words.select("w", F.length("w").alias("n")).withColumn("k", F.array_max(F.array(*need))).where("k is not null")
        # Strings are many times the words they come from: partitions aren't put together by the words' size, and no plan made by it sends them to the driver.
        most = most.repartition(int(keywords.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        once = most.withColumn("d1", F.when(F.col("k") > 0, F.array_distinct(one(F.col("w")))).otherwise(F.array().cast("array<string>")))
        twice = F.when((F.col("k") > 1) & (F.col("n") > 1), F.flatten(F.transform("d1", one))).otherwise(F.array().cast("array<string>"))
        left = once.select("w", "n", F.explode(F.array_distinct(F.concat(F.array("w"), "d1", twice))).alias("s"))
        x, y = left.select(F.col("w").alias("a"), F.col("n").alias("na"), "s"), left.select(F.col("w").alias("b"), F.col("n").alias("nb"), "s")
        pairs = x.join(y.hint("merge"), "s").where((F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) < max_distance))
        return _verified(pairs.select("a", "b", F.least("na", "nb").alias("short"), F.greatest("na", "nb").alias("long")), max_distance, max_ratio)
    cut = lambda i: F.floor(F.col("short") * i / (F.col("k") + 1)).cast("int")
    parts = lambda: F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")
    # Every length the other keyword may have; without changes distinct keywords are no pair.
    index = words.select(F.col("w").alias("a"), F.length("w").alias("short"), F.explode(F.sequence(F.length("w"), F.length("w") + max_distance - 1)).alias("long")).withColumn("k", changes(F.col("long")))
    index = index.where("k > 0 and long - short <= k").select("a", "short", "long", "k", parts())
    index = index.select("a", "short", "long", "i", F.substring("a", cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("seg"))
    probe = words.select(F.col("w").alias("b"), F.length("w").alias("long")).withColumn("k", changes(F.col("long"))).where("k > 0")
    probe = probe.select("b", "long", "k", F.explode(F.sequence(F.greatest(F.col("long") - F.col("k"), F.lit(1)), F.col("long"))).alias("short")).select("*", parts())
    probe = probe.select("b", "short", "long", "i", cut(F.col("i")).alias("p"), (cut(F.col("i") + 1) - cut(F.col("i"))).alias("m"), "k")
    probe = probe.select("b", "short", "long", "i", "m", F.explode(F.sequence(F.greatest(F.col("p") - F.col("k"), F.lit(0)), F.col("p") + F.col("k"))).alias("at"))
    probe = probe.where("at + m <= long").select("b", "short", "long", "i", F.substring("b", F.col("at") + 1, F.col("m")).alias("seg")).distinct()
    pairs = index.join(probe, ["short", "long", "i", "seg"]).where((F.col("short") < F.col("long")) | (F.col("a") < F.col("b")))
    return _verified(pairs.select("a", "b", "short", "long"), max_distance, max_ratio)


def _verified(pairs: DataFrame, max_distance: int, max_ratio: float) -> DataFrame:
    near = pairs.withColumn("distance", F.levenshtein("a", "b", max_distance - 1)).where("distance >= 0")
    near = near.where((F.col("distance") / F.col("long") < max_ratio) | (F.col("distance") / F.col("short") < max_ratio))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def grouped_close_keywords(pairs: DataFrame) -> DataFrame:
    """keyword, close: every keyword with all those near it, sorted."""
    two = pairs.select(F.col("a").alias("keyword"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("keyword"), F.col("a").alias("other")))
    return two.groupBy("keyword").agg(F.array_sort(F.collect_set("other")).alias("close"))


def closer_terms(pairs: DataFrame, name: str = "term") -> DataFrame:
    """For each term the other terms at its least distance. pairs: a, b, distance."""
    two = pairs.select(F.col("a").alias(name), F.col("b").alias("other"), "distance").unionByName(pairs.select(F.col("b").alias(name), F.col("a").alias("other"), "distance"))
    least = two.groupBy(name).agg(F.min("distance").alias("distance"))
    return two.join(least, [name, "distance"]).select(name, "other", "distance")


# --- skipgram similarity ---


def skipgram_index(terms: DataFrame, term: str = "term", n: int = 2, skip: int = 2) -> DataFrame:
    """term, len, norm, sg, freq: distinct terms by their skipgrams, once the index of rank_similar()."""
    grams = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct().select("term", F.explode(F.transform(C.skipgrams("term", n, skip), lambda g: g["sg"])).alias("sg"))
    counts = grams.groupBy("term", "sg").agg(F.count("*").alias("freq"))
    norms = counts.groupBy("term").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("norm"))
    return counts.join(norms, "term").select("term", F.length("term").alias("len"), "norm", "sg", "freq")


def similarities(index: DataFrame, queries: DataFrame, max_length_diff: int = 2) -> DataFrame:
    """query, term, score: cosine of skipgram counts of query terms (index rows of them) with terms of about their length."""
    q = queries.select(F.col("term").alias("query"), F.col("len").alias("qlen"), F.col("norm").alias("qnorm"), "sg", F.col("freq").alias("qfreq"))
    q = q.withColumn("len", F.explode(F.sequence(F.greatest(F.col("qlen") - max_length_diff, F.lit(0)), F.col("qlen") + max_length_diff)))
    dot = index.join(q, ["sg", "len"]).groupBy("query", "term", "norm", "qnorm").agg(F.sum(F.col("freq") * F.col("qfreq")).alias("dot"))
    return dot.select("query", "term", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def rank_similar(index: DataFrame, queries: DataFrame, top_n: int = 10, score_cutoff: float = 0.5, max_length_diff: int = 2) -> DataFrame:
    """query, term, score, rank: per query the top_n terms of at least score_cutoff, the query itself among them if indexed."""
    found = similarities(index, queries, max_length_diff).where(F.col("score") >= score_cutoff)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_n)


# --- byte-pair encoding ---


def bpe_tokens(tokens: DataFrame, token: str = "token") -> DataFrame:
    """token, freq, symbols: distinct tokens as characters and a closing space."""
    return tokens.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count("*").alias("freq")).withColumn("symbols", F.concat(C.chars("token"), F.array(F.lit(" "))))


def symbol_pairs(symbols: str | Column) -> Column:
    """Adjacent pairs of an array of symbols."""
    s = F.col(symbols) if isinstance(symbols, str) else symbols
    size = F.greatest(F.size(s) - 1, F.lit(0))
    return F.zip_with(F.slice(s, 1, size), F.slice(s, 2, size), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def pair_counts(types: DataFrame) -> DataFrame:
    """left, right, freq: in how many tokens each adjacent pair stands, once a token type however often it repeats in it."""
    return types.select("freq", F.explode(F.array_distinct(symbol_pairs("symbols"))).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def most_frequent_pairs(counts: DataFrame, n: int = 1) -> DataFrame:
    """Pairs by frequency, then shorter joined length, then alphabet."""
    return counts.orderBy(F.desc("freq"), F.length("left") + F.length("right"), "left", "right").limit(n)


def update_pair_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """counts with deltas (left, right, delta) added; pairs at or below 0 leave."""
    all_ = counts.unionByName(changes.select("left", "right", F.col("delta").alias("freq")))
    return all_.groupBy("left", "right").agg(F.sum("freq").alias("freq")).where("freq > 0")


def pairs_of_max_frequency(counts: DataFrame) -> DataFrame:
    return counts.join(counts.agg(F.max("freq").alias("freq")), "freq").select("left", "right", "freq")


def merge_pair(symbols: str | Column, left: str, right: str) -> Column:
    """Symbols with each occurrence of a pair joined, from left to right."""
    s = F.col(symbols) if isinstance(symbols, str) else symbols

    def step(acc: Column, x: Column) -> Column:
        joins = acc["open"] & (x == right)
        done = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.lit(left + right)))
        return F.struct(F.when(joins, done).otherwise(F.concat(acc["out"], F.array(x))).alias("out"), F.when(joins, F.lit(False)).otherwise(x == left).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(s, start, step, lambda acc: acc["out"])


def byte_pair_encoding(tokens: DataFrame, k: int, token: str = "token", keep_every: int = 8) -> tuple[DataFrame, DataFrame]:
    """(symbols, merges): the symbol set after k merges, and the merges (step, left, right, freq) in order.

    Each merge depends on the last, so steps run one after the other; each is an aggregate over distinct tokens, and the state is
    written every keep_every steps. Stops early when no pair is left.
    """
    spark = tokens.sparkSession
    types = stored(bpe_tokens(tokens, token))
    base = types.select(F.explode("symbols").alias("symbol")).distinct()
    merges: list[tuple[int, str, str, int]] = []
    for step in range(k):
        best = most_frequent_pairs(pair_counts(types)).first()
        if best is None:
            break
        merges.append((step, best.left, best.right, best.freq))
        has = F.array_contains("symbols", best.left) & F.array_contains("symbols", best.right)
        types = types.withColumn("symbols", F.when(has, merge_pair("symbols", best.left, best.right)).otherwise(F.col("symbols")))
        if step % keep_every == keep_every - 1:
            types = stored(types)
    table = spark.createDataFrame(merges, "step int, left string, right string, freq long")
    return base.unionByName(table.select(F.concat("left", "right").alias("symbol"))).distinct(), table
