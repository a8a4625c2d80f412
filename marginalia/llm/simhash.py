"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of at most `max_bits` = 3 differing bits differ in at most 3 of their 8 bytes, so a linked pair shares at least
5 positional bytes. Postings are kept per distinct fingerprint, however many documents have it. A single byte's list would
hold 1/256 of all fingerprints; so the index's terms are groups of three positional bytes, the triples that lie within a half of the
positions, for two ways to halve them. Any five shared bytes hold a whole triple of each halving. So a pair's tally, the number of terms whose
lists it is found in, is 2 at least if it is linked; pairs that share three bytes by chance are found in one list and go. What is left is verified
bit by bit.

No list is cut short. A list of more than `hot` fingerprints is split by every pair of the five other positions (five shared
bytes include the triple and two more). A list still hot then shares five whole bytes; its fingerprints look up every value
that their other three bytes can take within three bits (2325 probes), which is linear in the list. A pair found so counts once for its triple.

Links form components by alternating large and small stars over the distinct fingerprints; each round's edges are written to
the shared folder.

Words are runs without ASCII white space, A-Z lower-cased; shingles of three words, with repeats; fewer words make one
shingle, none the zero fingerprint, which links like any other. Nulls: a null text has no words; null ids are allowed but
can't represent a component. Rows of one id and text are documents of their own. Empty tables give empty results. Other
columns are not read by the digest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, identity, join_hot, map_docs, stored, table

MAX_BITS, HOT = 3, 512
HALVES = [(0, 1, 2, 3), (4, 5, 6, 7)], [(0, 1, 4, 5), (2, 3, 6, 7)]
TRIPLES = [t for halving in HALVES for half in halving for t in combinations(half, 3)]


def least_tally(max_bits: int) -> int:
    """In how many lists a pair of at most max_bits differing bits is found at least."""
    return min(sum(set(t) <= set(shared) for t in TRIPLES) for shared in combinations(range(8), 8 - max_bits))


def fingerprint(text: bytes, n: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, signed."""
    words = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= n:
        h = [h64(b" ".join(words), 42)]
    else:
        h = [h64(a + b" " + b + b" " + c, 42) for a, b, c in zip(words, words[1:], words[2:])] if n == 3 else [h64(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    raw = np.array(h, dtype="<u8")
    if len(raw) == 1:
        return int(raw.astype("<i8")[0])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 14):
        part = raw[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long). No shuffle."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in as_bytes(b, text_col)], pa.int64())], names=["doc_id", "fp"])

    return map_docs(docs, [id_col, text_col], each, "doc_id long, fp long")


def _byte(fp: str | Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _term(fp: str, places: tuple[int, ...], number: int) -> Column:
    """The index term of some positional bytes: the term's number above the bytes."""
    out = F.lit(number).cast("long")
    for i in places:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(fp, i))
    return out


def _split(postings: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Postings (k, fp) of lists of two up to `hot`, and those of longer ones."""
    sizes = postings.groupBy("k").count().where("count > 1")
    sized = postings.join(sizes, "k")
    return sized.where(F.col("count") <= hot).select("k", "fp"), sized.where(F.col("count") > hot).select("k", "fp")


def _pairs(postings: DataFrame, triple: Column) -> DataFrame:
    """(a, b, triple) of every two fingerprints of a list of bounded length; triple: as an expression of the list's k."""
    a, b = postings.select("k", F.col("fp").alias("a")), postings.select(F.col("k").alias("k2"), F.col("fp").alias("b"))
    return a.join(b, (F.col("k") == F.col("k2")) & (F.col("a") < F.col("b"))).select("a", "b", triple.cast("int").alias("triple"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (fps: fp) at most max_bits (up to 3) apart; each pair once."""
    if max_bits > 3:
        raise ValueError("the index guarantees pairs of up to 3 differing bits")
    terms = F.array(*[_term("fp", t, i) for i, t in enumerate(TRIPLES)])
    first = stored(fps.select(F.explode(terms).alias("k"), "fp"))
    cold, warm = _split(first, hot)
    number = F.shiftrightunsigned("k", 24)
    found = _pairs(cold, number)
    warm = stored(warm)
    if not warm.isEmpty():
        deeper = F.lit(None).cast("array<long>")
        for i, t in enumerate(TRIPLES):
            rest = [p for p in range(8) if p not in t]
            deeper = F.when(number == i, F.array(*[_term("fp", (*t, *p), i * 10 + j) for j, p in enumerate(combinations(rest, 2))])).otherwise(deeper)
        second, glowing = _split(stored(warm.select(F.explode(deeper).alias("k"), "fp")), hot)
        found = found.unionByName(_pairs(second, F.floor(F.shiftrightunsigned("k", 40) / 10))).unionByName(_probe(stored(glowing), max_bits)).distinct()
    tallied = found.groupBy("a", "b").agg(F.count("*").alias("tally")).where(F.col("tally") >= least_tally(max_bits))
    return stored(tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b"))


def _probe(postings: DataFrame, max_bits: int) -> DataFrame:
    """Pairs within hot lists of five shared bytes: each fingerprint looks up what differs in up to max_bits of the other 24 bits."""
    rows = []
    for i, t in enumerate(TRIPLES):
        for j, more in enumerate(combinations([p for p in range(8) if p not in t], 2)):
            bits = [8 * p + x for p in range(8) if p not in t and p not in more for x in range(8)]
            for r in range(1, max_bits + 1):
                rows += [(i * 10 + j, m - (1 << 64) if m >> 63 else m) for m in (sum(1 << x for x in c) for c in combinations(bits, r))]
    number, masks = np.array([x for x, _ in rows], np.int32), np.array([x for _, x in rows], np.int64)
    spark = postings.sparkSession
    table_ = spark.createDataFrame(pa.table({"number": number, "m": masks}))  # 160 * 2324 rows, whatever the input
    probes = postings.withColumn("number", F.shiftrightunsigned("k", 40).cast("int")).join(F.broadcast(table_), "number")
    probes = probes.select("k", "number", F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("m")).alias("b")).where("a < b")
    return probes.join(postings.select("k", F.col("fp").alias("b")), ["k", "b"]).select("a", "b", F.floor(F.col("number") / 10).cast("int").alias("triple"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Alternates large and small stars, which need O(log^2 n) rounds; each star is one pass that groups by a node and keeps
    only its least neighbour, so no task gathers a node's neighbours.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(low, "u")
        moved = linked.where("v > u").select("v", "m") if large else linked.select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    for _ in range(rounds):
        e = stored(star(stored(star(e, True)), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _classes(by_doc: DataFrame, max_bits: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fp, n, least id of every distinct fingerprint; links; fp and root of the linked ones), stored."""
    classes = stored(by_doc.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    pairs = links(classes.select("fp"), max_bits, hot)
    if pairs.isEmpty():
        return classes, pairs, by_doc.sparkSession.createDataFrame([], "fp long, root long")
    return classes, pairs, stored(components(pairs).withColumnRenamed("node", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), n_near (others at most max_bits away), component_id (least doc_id reachable)."""
    by_doc = stored(fingerprints(docs, id_col, text_col))
    classes, pairs, member = _classes(by_doc, max_bits, hot)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("around"))
    roots = member.join(classes.select("fp", "least"), "fp").groupBy("root").agg(F.min("least").alias("found"))
    found = member.join(roots, "root").select("fp", "found")
    facts = classes.join(near, "fp", "left").join(found, "fp", "left")
    facts = stored(facts.select("fp", "n", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_near"), F.coalesce("found", "least").alias("component_id")))
    out = join_hot(by_doc, facts, ["fp"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that of the least id; of several rows of that id, or if none has an id, one
    by a hash of the whole row. So rows without an id, and rows of one id and different texts, are documents like any other."""
    marked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *identity(docs))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([fingerprint(t) for t in as_bytes(b, "text")], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_d1"), b.column("_d2"), fp], names=["doc_id", "_d1", "_d2", "fp"])

    by_doc = stored(map_docs(marked, marked.columns, each, "doc_id long, _d1 long, _d2 long, fp long"))
    _, _, member = _classes(by_doc, max_bits, hot)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_d1", "_d2"))
    # One row a fingerprint first, so that no group of copies is joined whole.
    per = by_doc.groupBy("fp").agg(first.alias("first")).join(member, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first.*")
    kept = per.groupBy("root").agg(first.alias("first")).select("first._d1", "first._d2")
    rows = docs.select(F.struct("*").alias("d"), *identity(docs))
    if not by_doc.groupBy("_d1", "_d2").count().where("count > 1").isEmpty():
        rows = rows.groupBy("_d1", "_d2").agg(F.first("d").alias("d"))
    return rows.join(kept, ["_d1", "_d2"], "left_semi").select("d.*")


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents: a row each, repeated rows too. Null and empty texts have fingerprint zero; an empty table gives none."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_near_duplicates": op9_simhash_near_duplicates}
SQL: dict[str, str] = {}
