"""Line dedup by a log-template tree.

Units of text are parsed down a fixed-depth tree: the number of a unit's words, then its leading words; a word with a digit is a
variable field from the start. Units are lines, and runs of `run` words that don't depend on where lines end, so that a passage
spliced into longer lines, or broken into others, is found as well. Of all runs of a document those are taken whose hash is least among
`run` neighbours (winnowing), and its first and last; two documents that share 2 * run - 1 words in a row share a run.

At the leaf the words of a line that follow are taken in four quarters. Two lines of a leaf have a template in common if all
quarters but at most one agree: that one is the template's variable field. So a template is a key (leaf, the quarter left open or none, the
other quarters), counted like any group, and no lines are compared pairwise. A run's template leaves nothing open but words with digits.

A template recurs if its units stand in at least `min_docs` documents; templates of at least `long_words` fixed words need
`min_docs_long`, as passages of that length don't recur by chance. Of a recurring template the first unit (by document id,
then place) stays and all others are dropped; with open quarters at least `min_fixed` words must be fixed, and open quarters
are only tried at lines of `open_from` words and more. Of a dropped run those words go that stand in lines that stay; what is left of such a
line is joined by single spaces. A document that would lose at least `whole` of its words is kept as it is: it is a copy as a whole, which is
the business of near-duplicate removal.

Units whose leaf is found in one document only leave after the first aggregate, over leaves alone; a run's leaf holds all of its words. Leaf
and key are independent 64-bit hashes and group together, so different words meet by chance in one of 2**64 leaves only. Groups are
reduced by partial aggregates and hot keys are joined by broadcast, so a line that a third of all documents share costs one row a task.

A line is what newlines end; its words are runs without ASCII white space; a line without words is never dropped. Documents
are told apart by id and text, so repeated rows count as one document and get the same result; a null id is an id. A null
text stays null and counts as empty. Empty tables give empty results. Other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stored, table

PARAMS = {"depth": 3, "min_docs": 5, "long_words": 12, "min_docs_long": 2, "min_fixed": 6, "open_from": 8, "run": 25, "whole": 0.8}
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2**64
#: Words are hashed by their bytes; the first one's low bits place runs, so that SQL can do the same.
_BYTE_BASES = 1000003, 0x2545F4914F6CDD1D
_PLACE_BITS = 31
#: A run is placed by the hashes of these of its words, as thirds of its length, with these weights.
_WEIGHTS = 1, 3, 5, 7
_SPREAD = 1640531527


_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A task takes texts of about so many bytes at a time, and keeps powers for so many words.
PIECE_BYTES = 1 << 20


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, `size` or more."""
    found = _powers_of.get(base)
    if found is None or len(found[0]) < size:
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        found = np.cumprod(up), np.cumprod(down)
        if size <= PIECE_BYTES // 4:
            _powers_of[base] = found
    return found


def _word_hashes(words: pa.Array, base: int) -> np.ndarray:
    """A hash of every word's bytes, one more each: the polynomial whose last byte has power 0. Words with a digit are all <*>."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]) if len(words) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    up = np.full(int(sizes.max(initial=0)) + 1, base, np.uint64)
    up[0] = 1
    power = np.cumprod(up)[np.repeat(ends[1:], sizes) - 1 - np.arange(len(raw))]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
    out = sums[ends[1:]] - sums[ends[:-1]]
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    mask = 0
    for c in b"<*>":
        mask = (mask * base + c + 1) % 2**64
    out[digits[ends[1:]] > digits[ends[:-1]]] = mask
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any run of words [a, b), whatever stands around it, by prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray, base: int):
        up, self.down = _powers(base, len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])

    def __call__(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a] + salt.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def placed(v: np.ndarray, width: int) -> np.ndarray:
    """Places of the least of every `width` values in a row, the first of equal ones, and both ends."""
    n = len(v)
    low, w = v << 32 | np.arange(n), 1
    while w < min(width, n):
        step = min(w, min(width, n) - w)
        low, w = np.minimum(low[: len(low) - step], low[step:]), w + step
    return np.unique(np.concatenate([low & 0xFFFFFFFF, [0, n - 1]]))


def _parsed(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes and the placing bits of every word of all texts, the words' number before every line, the lines' before every text), ends included."""
    lines = pc.split_pattern(pc.fill_null(text, "").cast(pa.large_string()), "\n")
    parts = pc.ascii_split_whitespace(lines.flatten())
    words = parts.flatten()
    real = pc.not_equal(words, "")
    line_at = np.asarray(lines.offsets).astype(np.int64)
    part_at = np.asarray(parts.offsets).astype(np.int64)
    word_at = np.concatenate([[0], np.cumsum(np.asarray(real))])[part_at - part_at[0]]
    d = pc.dictionary_encode(words.filter(real))
    one, two = (_word_hashes(d.dictionary.cast(pa.large_string()), base) for base in _BYTE_BASES)
    at = np.asarray(d.indices)
    return _mixed(one)[at], _mixed(two)[at], (one & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)[at], word_at, line_at - line_at[0]


def _of_batch(b: pa.RecordBatch, p: dict) -> pa.RecordBatch:
    h, h2, low, word_at, line_at = _parsed(b.column("text"))
    one, two = _Hashes(h, _BASES[0]), _Hashes(h2, _BASES[1])
    texts = np.arange(b.num_rows)
    # Lines.
    n = np.diff(word_at)
    some, depth = np.nonzero(n)[0], p["depth"]
    owner = np.repeat(texts, np.diff(line_at))[some]
    start, n = word_at[some], n[some]
    rest = np.maximum(n - depth, 0)
    leaf = one(start, start + np.minimum(n, depth), n)
    quarter = [one(start + np.minimum(n, depth) + rest * i // 4, start + np.minimum(n, depth) + rest * (i + 1) // 4, np.full(len(n), i + 1)) for i in range(4)]
    # Runs.
    k = p["run"]
    v = np.zeros(max(0, len(h) - k + 1), np.int64)
    for i, weight in enumerate(_WEIGHTS):
        at = (k - 1) * i // 3
        v += weight * low[at : at + len(v)]
    v = (v & (1 << _PLACE_BITS) - 1) * _SPREAD & (1 << _PLACE_BITS) - 1
    begin = word_at[line_at]
    at = [a + placed(v[a : z - k + 1], k) for a, z in zip(begin[:-1], begin[1:]) if z - a >= k]
    runs = np.concatenate(at) if at else np.zeros(0, np.int64)
    of = np.searchsorted(begin, runs, side="right") - 1
    salt = np.full(len(runs), k)
    # Both.
    rows = pa.array(np.concatenate([owner, of]))
    place = np.concatenate([some - line_at[owner], runs - begin[of]])
    place += np.concatenate([n << 32, np.full(len(runs), 1 << 62 | k << 32)])
    quarters = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * 4), pa.array(np.stack(quarter, 1).ravel().view(np.int64)))
    cols = [
        b.column("doc_id").take(rows), b.column("doc").take(rows), pa.array(place), pa.array(np.concatenate([leaf, one(runs, runs + k, salt + (1 << 32))]).view(np.int64)),
        pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(two(runs, runs + k, salt).view(np.int64))]), pa.concat_arrays([quarters, pa.nulls(len(runs), quarters.type)]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc", "unit", "leaf", "check", "q"])


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """A row per line with a word and per run taken: doc_id, doc (hash of id and text), unit, leaf, check (a run's second hash), q (of a line's four quarters).

    unit is its place (line or word, from 0), its number of words times 2**32, and 2**62 for a run. One pass over the texts, which stay behind.
    """
    p = PARAMS | params
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))

    def run(it):
        for b in it:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(size, PIECE_BYTES + (size[at - 1] if at else 0), side="right")) - at)
                out = _of_batch(b.slice(at, n), p)
                at += n
                for i in range(0, out.num_rows, 100_000):
                    yield out.slice(i, 100_000)

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, doc long, unit long, leaf long, check long, q array<long>")


def _keys(p: dict) -> Column:
    """A unit's template keys: (key, fixed words), the closed one first."""
    n = F.shiftright("unit", 32).bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    rest = F.greatest(n - p["depth"], F.lit(0))
    closed = F.struct(F.coalesce("check", F.xxhash64("q")).alias("key"), n.alias("fixed"))
    out, able = F.array(closed), F.col("check").isNull() & (n >= p["open_from"])
    for i in range(4):
        fixed = n - (F.floor(rest * (i + 1) / 4) - F.floor(rest * i / 4)).cast("int")
        left = [F.col("q")[j] for j in range(4) if j != i]
        one = F.array(F.struct(F.xxhash64(F.lit(i), *left).alias("key"), fixed.alias("fixed")))
        out = F.concat(out, F.when(able & (fixed >= p["min_fixed"]), one).otherwise(F.array().cast("array<struct<key:bigint,fixed:int>>")))
    return out


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc, run, at) of every unit to drop."""
    p = PARAMS | params
    parsed = stored(units(docs, id_col, text_col, **p))
    leaves = stored(parsed.groupBy("leaf").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("leaf", "rows"))
    shared = join_hot(parsed, leaves, ["leaf"], "rows")
    keyed = stored(shared.select("doc_id", "doc", "unit", "leaf", F.explode(_keys(p)).alias("k")).select("doc_id", "doc", "unit", "leaf", "k.key", "k.fixed"))
    # Distinct documents: first one row a document and key, then one a key. Units of a key are of one kind and number of words, so they compare by place.
    per_doc = keyed.groupBy("leaf", "key", "doc").agg(F.min("doc_id").alias("doc_id"), F.min("unit").alias("unit"), F.min("fixed").alias("fixed"), F.count("*").alias("rows"))
    place = F.struct(F.col("doc_id").isNotNull().alias("z"), "doc_id", "doc", "unit")
    per_key = per_doc.groupBy("leaf", "key").agg(F.count("*").alias("docs"), F.min(place).alias("first"), F.min("fixed").alias("fixed"), F.sum("rows").alias("rows"))
    need = F.when(F.col("fixed") >= p["long_words"], p["min_docs_long"]).otherwise(p["min_docs"])
    found = stored(per_key.where(F.col("docs") >= need).select("leaf", "key", "rows", F.col("first.doc").alias("first_doc"), F.col("first.unit").alias("first_unit")))
    hits = join_hot(keyed.select("leaf", "key", "doc", "unit"), found, ["leaf", "key"], "rows").where((F.col("doc") != F.col("first_doc")) | (F.col("unit") != F.col("first_unit")))
    return hits.select("doc", "unit").distinct().select("doc", (F.col("unit") >= F.lit(1 << 62)).alias("run"), F.col("unit").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))


def without(text: str, lines: list[int], runs: list[int], p: dict) -> tuple[str | None, list[int], int]:
    """(text without these lines and runs, places of lines that went, how many words went); nothing goes if too much would."""
    raw = text.encode()
    parts = raw.split(b"\n")
    sizes = np.fromiter((len(x.split()) for x in parts), np.int64, len(parts))  # bytes: ASCII white space only
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    edge = np.zeros(n + 1, np.int32)
    if len(runs):
        np.add.at(edge, runs, 1)
        np.add.at(edge, np.asarray(runs) + p["run"], -1)
    for i in lines:
        edge[ends[i] - sizes[i]] += 1
        edge[ends[i]] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(gone)])
    lost = before[ends] - before[ends - sizes]
    if before[-1] >= p["whole"] * n:
        return None, [], 0
    went = np.nonzero((lost > 0) & (lost == sizes))[0]
    for i in np.nonzero((lost > 0) & (lost < sizes))[0]:
        own = gone[ends[i] - sizes[i] : ends[i]]
        parts[i] = b" ".join([w for w, x in zip(parts[i].split(), own) if not x])
    skip = set(went.tolist())
    return b"\n".join([x for i, x in enumerate(parts) if i not in skip]).decode(), went.tolist(), int(before[-1])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs as struct d, with n_lines, dropped (sorted places of lines that went), n_words (that went) and kept_text."""
    p = PARAMS | params
    at = lambda run: F.sort_array(F.collect_list(F.when(F.col("run") == run, F.col("at"))))
    drop = stored(recurring(docs, id_col, text_col, **params).groupBy("doc").agg(at(False).alias("lines"), at(True).alias("runs")))
    both = drop.join(docs.select(F.struct("*").alias("d"), F.xxhash64(id_col, text_col).alias("doc")), "doc", "right")

    @F.pandas_udf("text string, dropped array<int>, n_words long")
    def cut(text: pd.Series, lines: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = [(None, [], 0) if t is None else without(t, a, r, p) for t, a, r in zip(text, lines, runs)]
        return pd.DataFrame(out, columns=["text", "dropped", "n_words"])

    text = F.col(f"d.`{text_col}`")
    # Texts that lose nothing don't go to Python.
    both = both.withColumn("x", cut(F.when(F.col("lines").isNotNull(), text), "lines", "runs"))
    n_lines = F.when(text.isNotNull(), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return both.select("d", n_lines.cast("long").alias("n_lines"), F.coalesce("x.dropped", F.array().cast("array<int>")).alias("dropped"), F.coalesce("x.n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("x.text", text).alias("kept_text"))


def apply_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", **params) -> DataFrame:
    """docs with recurring lines and runs taken out of the text; n_chars follows the text. No document goes."""
    d = dedup(docs, id_col, text_col, **params)
    cols = [F.col("kept_text").alias(c) if c == text_col else F.char_length("kept_text").cast("long").alias(c) if c == n_chars_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    return d.select(*cols)


def op5_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines (places from 0, comma-joined) of lines that went, n_words that went, text (what is left).

    Null and empty texts lose nothing; repeated rows get the same result; an empty table gives none.
    """
    d = dedup(table(spark, sf_dir, "documents"))
    return d.select("d.doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped_lines"), "n_words", F.col("kept_text").alias("text"))


def _sql() -> str:
    p, k = PARAMS, PARAMS["run"]
    rest = f"greatest(n - {p['depth']}, 0)"
    part = lambda i: f"w[{p['depth']} + 1 + ({rest} * {i}) // 4 : {p['depth']} + ({rest} * {i + 1}) // 4]"
    width = lambda i: f"(({rest} * {i + 1}) // 4 - ({rest} * {i}) // 4)"
    lead = f"to_json(w[1 : {p['depth']}])"
    open_ = " UNION ALL ".join(
        f"SELECT doc_id, line, n - {width(i)} AS fixed, concat_ws(' | ', n, {lead}, 'open {i}', {', '.join(f'to_json({part(j)})' for j in range(4) if j != i)}) AS key "
        f"FROM words WHERE n >= {p['open_from']} AND n - {width(i)} >= {p['min_fixed']}"
        for i in range(4)
    )
    byte = "list_transform(range(1, length(hex(x)) + 1, 2), lambda i: ('0x' || substr(hex(x), i::INT, 2))::BIGINT + 1)"
    value = " + ".join(f"{weight} * h[i + {(k - 1) * j // 3}]" for j, weight in enumerate(_WEIGHTS))
    least = f"CASE WHEN min(fixed) >= {p['long_words']} THEN {p['min_docs_long']} ELSE {p['min_docs']} END"
    return f"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
words AS (SELECT *, len(w) AS n FROM (SELECT doc_id, line, regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+') AS r, list_transform(r, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM split) WHERE len(w) > 0),
keyed AS (SELECT doc_id, line, n AS fixed, concat_ws(' | ', n, 'closed', to_json(w)) AS key FROM words UNION ALL {open_}),
found AS (SELECT key, min((doc_id, line)) AS first FROM keyed GROUP BY key HAVING count(DISTINCT doc_id) >= {least}),
hit AS (SELECT DISTINCT doc_id, line FROM keyed JOIN found USING (key) WHERE (doc_id, line) <> first),
whole AS (SELECT doc_id, flatten(list(w ORDER BY line)) AS w FROM words GROUP BY doc_id),
hashed AS (SELECT doc_id, w, list_transform(w, lambda x: list_reduce({byte}, lambda a, b: (a * {_BYTE_BASES[0]} + b) % {1 << _PLACE_BITS})) AS h FROM whole WHERE len(w) >= {k}),
runs AS (SELECT doc_id, i, n, (({value}) % {1 << _PLACE_BITS} * {_SPREAD} % {1 << _PLACE_BITS}) * 4294967296 + i - 1 AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT doc_id, h, len(h) - {k - 1} AS n FROM hashed))),
low AS (SELECT doc_id, i, n, min(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) % 4294967296 AS "at" FROM runs),
taken AS (SELECT doc_id, "at" FROM low WHERE i <= greatest(n - {k - 1}, 1) UNION SELECT doc_id, 0 FROM low UNION SELECT doc_id, n - 1 FROM low),
cut AS (SELECT taken.doc_id, "at", to_json(w["at" + 1 : "at" + {k}]) AS key FROM taken JOIN hashed USING (doc_id)),
often AS (SELECT key, min((doc_id, "at")) AS first FROM cut GROUP BY key HAVING count(DISTINCT doc_id) >= {p['min_docs_long'] if k >= p['long_words'] else p['min_docs']}),
under AS (SELECT DISTINCT doc_id, unnest(range("at", "at" + {k})) AS k FROM cut JOIN often USING (key) WHERE (doc_id, "at") <> first),
each AS (SELECT doc_id, line, r, unnest(range(n)) AS j, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM words),
marked AS (SELECT e.doc_id, e.line, j, r[j + 1] AS word, hit.line IS NOT NULL OR under.k IS NOT NULL AS gone
  FROM each e LEFT JOIN hit ON hit.doc_id = e.doc_id AND hit.line = e.line LEFT JOIN under ON under.doc_id = e.doc_id AND under.k = before + j),
partly AS (SELECT doc_id FROM marked GROUP BY doc_id HAVING count(*) FILTER (WHERE gone) < {p['whole']}::DOUBLE * count(*)),
tally AS (SELECT doc_id, line, count(*) FILTER (WHERE gone) AS lost, count(*) AS n, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS rest FROM marked JOIN partly USING (doc_id) GROUP BY doc_id, line),
rebuilt AS (SELECT split.doc_id, string_agg(CASE WHEN lost > 0 THEN rest ELSE s END, chr(10) ORDER BY line) FILTER (WHERE lost IS NULL OR lost < n) AS text, count(*) AS n_lines, count(*) FILTER (WHERE lost = n) AS n_dropped,
  string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (WHERE lost = n) AS dropped_lines, sum(lost) AS n_words FROM split LEFT JOIN tally USING (doc_id, line) GROUP BY split.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines, coalesce(n_words, 0)::BIGINT AS n_words,
  CASE WHEN d.text IS NULL THEN NULL ELSE rebuilt.text END AS text
FROM documents d LEFT JOIN rebuilt USING (doc_id)"""


QUERIES = {"op5_template_lines": op5_template_lines}
SQL = {"op5_template_lines": _sql()}
