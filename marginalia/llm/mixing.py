"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot k of the schedule takes the golden-ratio point frac(k * phi), in exact 64-bit integers, through the cumulative target
shares to a source; the slot's rank among that source's slots is the number of the block it takes. A source's blocks are
equal runs of `block_words` words of its documents in shuffled (hashed) order, joined end to end and read as a ring: block
r has words r * block_words to (r + 1) * block_words of that ring, up to `max_repeat` turns. Slots are joined to blocks on source and
rank, and what a document gives is the sum of its words in the blocks that were joined. Any prefix of the schedule is close to the
target shares.

The schedule is made in Spark for any number of sources. Points meet the sources' bounds in equal cells of the unit interval, sorted, so
each point finds the last bound below it; as golden-ratio points are even, cells hold about equally many. Ranks are prefix counts over chunks
of 2**16 slots. Positions in the shuffled stream are prefix sums over hash buckets: first within a bucket, then over the
bucket totals, at most 2**16 a source. So no task holds a whole source, however hot; buckets of many equal rows are split.

Targets: a source's share of all words goes by its weight; it stops at `max_repeat` times the source's words and the excess
is shared again by weight until none is above. In order of words by weight those that stop come first, so one pass of prefix sums, in
exact integers, tells them.

Nulls: a null text has 0 words; a null source is a source of its own, last in order; a null id is allowed. Repeated rows are
documents of their own. Documents of 0 words take 0. An empty table gives an empty result. Columns of other names stay out
of the digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, identity, join_hot, most_rows, n_words, stored, table

GOLDEN = 0x9E3779B97F4A7C15  # 2**64 / phi, odd
MAX_REPEAT, BLOCK_WORDS, SEED = 3, 16, 10
#: A task sorts about so many documents of one source, until there are 2**16 buckets.
BUCKET_ROWS = 8192
#: Slots of a chunk, and about those of a cell, as powers of two.
CHUNK_BITS = 16
_SIGN = -(1 << 63)
_WIDE = "decimal(38,0)"


def _running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each name in sums, the sum of that column over the rows before, in order: within sorted ranges, then over these."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("_p").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = per.select("_p", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_b{name}") for name in sums])
    return ranged.join(before, "_p").select(*df.columns, *[(F.col(f"_b{name}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()])


class Plan(NamedTuple):
    """sources: _sk, _rows, _s (place by code point), _size, _target, and _lo, _hi (first and last 64-bit point, as signed longs less 2**63)."""

    sources: DataFrame
    total: int


PLANNED = "_sk string, _rows long, _s long, _source_size long, _target double, _lo long, _hi long"


def plan(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> Plan:
    """sources: _source, _source_size, _rows; a row a source, at any number."""
    keyed = sources.select(_key("_source").alias("_sk"), "_rows", "_source_size", F.col("_source").isNull().alias("_z"), F.coalesce("_source", F.lit("")).alias("_k"), F.lit(1).cast("long").alias("_one"))
    ranked = _running(keyed, ["_z", "_k"], {"_s": "_one"}).withColumn("_w", F.col("_s") % 3 + 1).withColumn("_cap", F.lit(max_repeat) * F.col("_source_size"))
    ranked = stored(ranked.drop("_z", "_k", "_one").withColumn("_order", F.col("_cap") * (F.lit(6) / F.col("_w")).cast("long")))  # 6 is divisible by any weight
    total, weights = (int(x or 0) for x in ranked.agg(F.sum("_source_size"), F.sum("_w")).first())
    if not total:
        spread_ = ranked.select("_sk", "_rows", "_s", "_source_size", F.lit(0.0).alias("_target"), F.lit(0).cast("long").alias("_lo"), F.lit(-1).cast("long").alias("_hi"))
        return Plan(stored(spread_), 0)
    filled = _running(ranked, ["_order", "_s"], {"_c": "_cap", "_v": "_w"})
    stops = (F.lit(total).cast(_WIDE) - F.col("_c")) * F.col("_w") > F.col("_cap").cast(_WIDE) * (F.lit(weights) - F.col("_v"))
    filled = stored(filled.withColumn("_stops", stops).drop("_c", "_v"))
    capped, weight = (int(x or 0) for x in filled.agg(F.sum(F.when(F.col("_stops"), F.col("_cap"))), F.sum(F.when(~F.col("_stops"), F.col("_w")))).first())
    left, weight = total - capped, max(weight, 1)
    shares = filled.withColumn("_c", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.lit(0))).withColumn("_v", F.when(F.col("_stops"), F.lit(0)).otherwise(F.col("_w")))
    shares = _running(shares.drop("_stops", "_order", "_cap", "_w"), ["_s"], {"_c0": "_c", "_v0": "_v"})
    scale = weight * total

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            target, lo, hi = [], [], []
            for r in b.to_pylist():
                start, own = r["_c0"] * weight + left * r["_v0"], r["_c"] * weight + left * r["_v"]
                target.append(own / weight)
                lo.append((start << 64) // scale + _SIGN if own else 0)  # no share: an interval that ends before it begins
                hi.append(((start + own) << 64) // scale - 1 + _SIGN if own else -1)
            cols = [b.column(c) for c in ("_sk", "_rows", "_s", "_source_size")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(target, pa.float64()), pa.array(lo, pa.int64()), pa.array([max(x, _SIGN) for x in hi], pa.int64())], names=[x.split()[0] for x in PLANNED.split(", ")])

    cols = ["_sk", "_rows", "_s", "_source_size", "_c", "_v", "_c0", "_v0"]
    whole = shares.select(*[F.col(c).cast("long").alias(c) if c in ("_c", "_v", "_c0", "_v0") else c for c in cols])
    return Plan(stored(whole.mapInArrow(run, PLANNED)), total)


def _key(source: str) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def slots(p: Plan, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule's slots: (slot long, _s long)."""
    spark, n = p.sources.sparkSession, -(-p.total // block_words)
    bits = (n >> CHUNK_BITS).bit_length()
    down = 64 - bits

    def points(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            k = b.column(0).to_numpy()
            x = k.view(np.uint64) * np.uint64(GOLDEN)
            cell = x >> np.uint64(down) if bits else np.zeros(len(x), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array((x ^ np.uint64(1 << 63)).view(np.int64)), pa.array(k)], names=["cell", "pos", "slot"])

    def filled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for b in it:
            s = b.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(s >= 0, np.arange(len(s)), -1))
            s = np.where(at >= 0, s[at], last)
            last = int(s[-1]) if len(s) else last
            real = b.column(2).is_valid()
            yield pa.RecordBatch.from_arrays([b.column(2).filter(real), pa.array(s).filter(real)], names=["slot", "_s"])

    drawn = spark.range(0, n, 1, max(1, min(4096, n >> 19))).mapInArrow(points, "cell long, pos long, slot long").withColumn("_s", F.lit(None).cast("long"))
    # A bound stands where its source begins and at the start of every further cell that the source reaches into.
    cell = lambda c: F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(_SIGN)), down) if bits else F.lit(0).cast("long")
    start = F.shiftleft("cell", down).bitwiseXOR(F.lit(_SIGN)) if bits else F.lit(_SIGN)
    some = p.sources.where("_target > 0 and _lo <= _hi").withColumn("cell", F.explode(F.sequence(cell("_lo"), cell("_hi"))))
    bounds = some.select("cell", F.greatest("_lo", start).alias("pos"), F.lit(None).cast("long").alias("slot"), "_s")
    both = drawn.unionByName(bounds).repartition("cell").sortWithinPartitions("cell", "pos", F.col("slot").asc_nulls_first())
    return both.mapInArrow(filled, "slot long, _s long")


def schedule(p: Plan, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(every slot with the rank of its block: slot, _s, rank; slots per source: _s, _slots). Ranks are prefix counts, per chunk and over chunks."""
    drawn = stored(slots(p, block_words).withColumn("chunk", F.shiftright("slot", CHUNK_BITS)))
    counts = stored(drawn.groupBy("_s", "chunk").agg(F.count("*").alias("n")))
    over = Window.partitionBy("_s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_s", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("_s", "chunk").orderBy("slot"))
    ranked = drawn.join(before, ["_s", "chunk"]).select("slot", "_s", (within - 1 + F.col("before")).alias("rank"))
    return ranked, counts.groupBy("_s").agg(F.sum("n").alias("_slots"))


def _place(sized: DataFrame, seed: int) -> DataFrame:
    """sized with _start, where a document's words begin in its source's ring: prefix sums over rows in hashed order."""
    n = sized.count()
    keyed = sized.withColumn("_h", F.xxhash64(F.lit(seed), "_d1", "_d2"))
    hot = keyed.groupBy("_h").count().where(F.col("count") > most_rows(n)).select("_h", F.lit(True).alias("_hot"))
    keyed = keyed.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 17), F.lit(min(1 << 16, max(1, n // BUCKET_ROWS)))))
    # Equal rows may stand in any order; where there are many they make parts of their bucket.
    keyed = keyed.join(F.broadcast(hot), "_h", "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(1000)) + 1).otherwise(F.lit(0).cast("long"))).drop("_hot")
    group = ["_sk", "_bucket", "_part"]
    over = Window.partitionBy("_sk").orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy(*group).agg(F.sum("_size").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group).orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(before, group).withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return placed.select(*sized.columns, "_start")


def mixed(sized: DataFrame, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """sized: _row (unique), _id, _sk, _source, _size, _d1, _d2, stored. (its rows with _source_size, _target, _start; what the mix reads of
    them: _row, _copy (turn of the ring), slot (of the first word), words)."""
    p = plan(sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_rows")), max_repeat)
    ranked, counts = schedule(p, block_words)
    sources = stored(p.sources.join(counts, "_s", "left").withColumn("_take", F.least(F.coalesce("_slots", F.lit(0)) * block_words, F.col("_source_size") * max_repeat)))
    placed = join_hot(stored(_place(sized, seed)), sources.drop("_lo", "_hi", "_slots"), ["_sk"], "_rows")
    placed = stored(placed)
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_take") - F.col("_start") - 1) / F.col("_source_size"))))
    copies = placed.where("_size > 0 and _start < _take").select("_row", "_s", "_size", "_start", "_source_size", "_take", turn.alias("_copy"))
    first = F.col("_start") + F.col("_copy") * F.col("_source_size")
    copies = copies.select("_row", "_s", "_copy", first.alias("_a"), F.least(first + F.col("_size"), F.col("_take")).alias("_z"))
    blocks = copies.select("*", F.explode(F.sequence(F.floor(F.col("_a") / block_words), F.floor((F.col("_z") - 1) / block_words))).alias("rank"))
    words = F.least(F.col("_z"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("_a"), F.col("rank") * block_words)
    joined = blocks.select("_row", "_copy", "_s", "rank", words.alias("words")).join(ranked, ["_s", "rank"])
    return placed, joined.groupBy("_row", "_copy").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(f"`{source_col}`").cast("string")
    out = docs.select(F.col(f"`{id_col}`").alias("_id"), source.alias("_source"), n_words(f"`{text_col}`").alias("_size"), *identity(docs))
    return stored(out.withColumn("_sk", _key("_source")).withColumn("_row", F.monotonically_increasing_id()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, start (of its words in its source's ring), first_slot (null: none)."""
    placed, read = mixed(_sized(docs, id_col, text_col, source_col), **options)
    per = read.groupBy("_row").agg(F.sum("words").alias("_taken"), F.min("slot").alias("first_slot"))
    out = placed.join(per, "_row", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.col("_start").alias("start"), "first_slot")


#: Groups of equal rows that are hot are given out by so many tasks.
SALTS = 64


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix in the schedule's order: each is there once for every turn of its source's ring that reads it, at the slot of its
    first word; the one at the end of a source's last turn gives its leading words. Documents that give none go. Equal rows are documents of their
    own, nulls in any column included. Columns stay as they are, n_chars follows the text. Empty tables give empty results."""
    sized = _sized(docs, id_col, text_col, source_col)
    placed, read = mixed(sized, **options)
    parts = stored(read.join(placed.select("_row", "_size", "_d1", "_d2"), "_row").select("_d1", "_d2", "slot", "words", "_size"))
    rows = docs.select(F.struct("*").alias("d"), *identity(docs))
    repeats = stored(sized.groupBy("_d1", "_d2").count().where("count > 1"))
    if not repeats.isEmpty():
        hot = F.broadcast(repeats.where(F.col("count") > most_rows(sized.count())).select("_d1", "_d2", F.lit(True).alias("_hot")))
        rows = rows.groupBy("_d1", "_d2").agg(F.first("d").alias("d")).join(hot, ["_d1", "_d2"], "left")
        rows = rows.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
        parts = parts.join(hot, ["_d1", "_d2"], "left").withColumn("_salt", F.when(F.col("_hot"), (F.col("slot") % SALTS).cast("int")).otherwise(F.lit(0))).drop("_hot")
    else:
        rows, parts = rows.withColumn("_salt", F.lit(0)), parts.withColumn("_salt", F.lit(0))
    both = rows.join(parts, ["_d1", "_d2", "_salt"])
    # Runs of slots go to partitions in order, so the files' order is the schedule's.
    total = int(sized.agg(F.sum("_size")).first()[0] or 0)
    n, tasks = max(1, -(-total // options.get("block_words", BLOCK_WORDS))), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("d", "slot", "words", "_size").repartitionById(tasks, F.least(F.floor(F.col("slot") * tasks / n), F.lit(tasks - 1)).cast("int")).sortWithinPartitions("slot", f"d.`{id_col}`")
    lead = f"array_join(slice(regexp_extract_all(d.`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]*{WORD}', 0), 1, cast(words as int)), '')"
    text = F.when(F.col("words") >= F.col("_size"), F.col(f"d.`{text_col}`")).otherwise(F.expr(lead))
    out = both.withColumn("_text", text)
    cols = [F.col("_text").alias(c) if c == text_col else F.char_length("_text").cast("long").alias(c) if c == n_chars_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols)


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents: a row each, repeated rows too. A null text has size 0 and takes 0; a null source is one of its own; an empty table gives none."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_source_schedule": op10_source_schedule}
SQL: dict[str, str] = {}
