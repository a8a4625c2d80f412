"""Registered queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.functions import patterns, tokens
from marginalia.operators import context, frequencies, phrase_search, templates, token_search, vocabularies
from marginalia.plans.model import PhraseModel
from marginalia.plans.template import Template
from marginalia.sources import matches as io
from marginalia.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PHRASES = ["of the", "in the", "the the", "under the MIT License", "All rights reserved", "rights reserved", "GNU General Public License", "General Public License", "Licensed under CC BY-NC", "under the Apache License", "the Apache"]
MODEL = [
    {"phrase": "GNU General Public License", "variants": ["General Public License"], "label": "copyleft"},
    {"phrase": "under the MIT License", "distractors": ["under the BSD License"], "label": ["permissive", "short"]},
    {"phrase": "under the Apache License", "label": "permissive"},
    {"phrase": "Licensed under", "variants": ["licensed under"], "label": "notice"},
    {"phrase": "This work", "label": "subject", "max_start_offset": 100000},
    {"phrase": "All rights reserved", "label": "reserved"},
]
TEMPLATE = {"label": "licence notice", "type": "group", "ordered": True, "elements": [{"label": "subject", "type": "label"}, {"label": "notice", "type": "label", "required": True}, {"label": "copyleft", "type": "label", "required": True}]}
TARGETS = ["small ring", "red widget", "blue gear", "smal rings", "large bolt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer partitions than there are cores is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return phrase_search.spread(df) if name in ("documents", "pages", "conversations") else df


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


# --- tokens and strings ---

_TILES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf"""
WITH p AS (SELECT doc_id, length(text) AS size, unnest(regexp_extract_all(text, '{_TILES}')) AS s, generate_subscripts(regexp_extract_all(text, '{_TILES}'), 1) AS k FROM documents),
q AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, s AS t, lower(s) AS n, q."at"::BIGINT AS char_index, (size - (q."at" + length(s) + 1))::BIGINT AS char_end_index FROM q WHERE NOT regexp_matches(s, '^\s')""")
def word_punct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens.tokenize("text", ignorecase=True)).alias("x"))
    return t.select("doc_id", F.col("x.i").cast("long").alias("i"), "x.t", "x.n", F.col("x.char_index").cast("long").alias("char_index"), F.col("x.char_end_index").cast("long").alias("char_end_index"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) + CASE WHEN regexp_matches(text, '\s$') THEN 1 ELSE 0 END AS n_tokens FROM documents""")
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens.tokenize_split("text")).cast("long").alias("n_tokens"))


@query("""
WITH t AS (SELECT DISTINCT p_name AS s FROM part)
SELECT s, n, i, substr('#' || s || '#', i::INT, n::INT) AS gram FROM t, (VALUES (1), (2), (3)) v(n), unnest(range(1, length(s) + 4 - n)) u(i) WHERE n <= length(s)""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("s")).distinct()
    parts = [t.select("s", F.lit(n).alias("n"), F.posexplode(C.ngrams("s", n)).alias("i", "gram")) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("s", "n", (F.col("i") + 1).cast("long").alias("i"), "gram")


@query("""
WITH t AS (SELECT DISTINCT p_name AS s FROM part)
SELECT s, substr(s, i::INT + 1, 1) || substr(s, i::INT + 1 + d, 1) AS sg, i AS start, length(s) - i + 1 AS end_offset, d + 1 AS len
FROM t, unnest(range(0, length(s) - 1)) u(i), (VALUES (1), (2), (3)) v(d) WHERE i + d < length(s)""")
def char_skipgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("s")).distinct()
    return t.select("s", F.explode(C.skipgrams("s")).alias("g")).select("s", "g.sg", F.col("g.start").cast("long").alias("start"), F.col("g.end_offset").cast("long").alias("end_offset"), F.col("g.len").cast("long").alias("len"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().select("a", F.explode(F.array(*[F.lit(x) for x in TARGETS])).alias("b"))


_MULTI = "list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x)))))"
_G2 = "list_transform(range(1, length({s}) + 2), lambda i: substr('#' || {s} || '#', i::INT, 2))"


@query(f"""
WITH p AS (SELECT a, b, string_split(a, '') AS ca, string_split(b, '') AS cb, {_G2.format(s="a")} AS ga, {_G2.format(s="b")} AS gb FROM (SELECT DISTINCT p_name AS a FROM part), (SELECT unnest({_list(TARGETS)}) AS b))
SELECT a, b, round({_MULTI.format(a="ca", b="cb")} / length(a), 6) AS char_ratio, round({_MULTI.format(a="ga", b="gb")} / len(ga), 6) AS ngram_ratio, levenshtein(a, b) AS distance,
  round(1 - levenshtein(left(a, least(4, length(a), length(b))::INT), left(b, least(4, length(a), length(b))::INT)) / least(4, length(a), length(b)), 6) AS begin_sim,
  abs(length(a) - length(b)) <= 3 AND levenshtein(a, b) < 3 AND (levenshtein(a, b) / length(a) < 0.3 OR levenshtein(a, b) / length(b) < 0.3) AS close,
  CASE WHEN length(a) <= 3 AND levenshtein(a, b) = abs(length(a) - length(b)) THEN NOT contains(b, a) ELSE levenshtein(a, b) - abs(length(a) - length(b)) > 2 END AS distractor
FROM p""")
def string_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return _pairs(spark, sf_dir).select(
        "a", "b", r(C.char_overlap_ratio("a", "b")).alias("char_ratio"), r(C.ngram_overlap_ratio("a", "b", 2)).alias("ngram_ratio"), C.levenshtein("a", "b").cast("long").alias("distance"),
        r(C.begin_similarity("a", "b", 4)).alias("begin_sim"), C.close_distance("a", "b", 3, 0.3).alias("close"), C.is_distractor("a", "b").alias("distractor"),
    )


@query(f"""
WITH RECURSIVE p AS (SELECT a, b, string_split(b, '') AS cb FROM (SELECT DISTINCT p_name AS a FROM part), (SELECT unnest({_list(TARGETS)}) AS b)),
step(a, b, cb, i, last) AS (
  SELECT a, b, cb, 0, list_transform(range(0, len(cb) + 1), lambda x: 0::BIGINT) FROM p
  UNION ALL
  SELECT a, b, cb, i + 1, list_reduce(range(1, len(cb) + 1), lambda acc, j: list_append(acc, CASE WHEN cb[j] = substr(a, i + 1, 1) THEN last[j] + 1 ELSE greatest(last[j + 1], acc[len(acc)]) END), [0::BIGINT]) FROM step WHERE i < length(a))
SELECT a, b, last[len(last)] AS common, round(2 * last[len(last)] / (length(a) + length(b)), 6) AS ratio FROM step WHERE i = length(a)""")
def indel_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", C.lcs("a", "b").cast("long").alias("common"), F.round(C.indel_ratio("a", "b"), 6).alias("ratio"))


_TWO, _ONE = _list(sorted(C.AFFIXES_2)), _list(sorted(C.AFFIXES_1))


@query(f"""
WITH t AS (SELECT doc_id, text AS s FROM documents)
SELECT doc_id, s, CASE WHEN list_contains({_TWO}, substr(s, 1, 2)) THEN substr(s, 1, 2) WHEN list_contains({_ONE}, substr(s, 1, 1)) THEN substr(s, 1, 1) ELSE '' END AS prefix,
  CASE WHEN list_contains({_TWO}, right(s, 2)) THEN right(s, 2) WHEN list_contains({_ONE}, right(s, 1)) THEN right(s, 1) ELSE '' END AS suffix,
  CASE WHEN length(s) <= 2 THEN s WHEN list_contains({_TWO}, substr(s, 1, 2)) OR substr(s, 2, 1) IN (' ', ',') THEN substr(s, 3) WHEN substr(s, 1, 1) IN (' ', ',') THEN substr(s, 2) ELSE s END AS stripped_start,
  CASE WHEN length(s) <= 2 THEN s WHEN substr(s, length(s) - 1, 1) IN (' ', ',') OR right(s, 2) IN (', ', '. ', '! ', '? ') THEN left(s, length(s) - 2) WHEN right(s, 1) IN (' ', ',') THEN left(s, length(s) - 1) ELSE s END AS stripped_end,
  regexp_replace(regexp_replace(s, '[^ \\t\\r\\n]', 'w', 'g'), '[ \\t\\r\\n]', 's', 'g') AS classes
FROM t""")
def affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s"))
    return s.select("doc_id", "s", C.non_word_prefix("s").alias("prefix"), C.non_word_suffix("s").alias("suffix"), C.strip_prefix("s").alias("stripped_start"), C.strip_suffix("s").alias("stripped_end"), C.map_string("s", whitespace_only=True).alias("classes"))


# --- searches ---

_W = r"'[\p{L}\p{N}_]'"
_EXACT = rf"""
SELECT doc_id, phrase, i - 1 AS "offset", i - 1 + length(phrase) AS "end", text FROM (SELECT doc_id, text, phrase, unnest(range(1, length(text) - length(phrase) + 2)) AS i FROM documents, (SELECT unnest({_list(PHRASES)}) AS phrase) WHERE contains(text, phrase))
WHERE substr(text, i::INT, length(phrase)) = phrase AND NOT (i > 1 AND regexp_matches(substr(text, i::INT - 1, 1), {_W}))
  AND NOT (i - 1 + length(phrase) < length(text) - 1 AND regexp_matches(substr(text, (i + length(phrase))::INT, 1), {_W}))"""


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = phrase_search.exact_matches(table(spark, sf_dir, "documents"), PhraseModel(PHRASES))
    return m.withColumn("offset", F.col("offset").cast("long")).withColumn("end", F.col("end").cast("long"))


@query(f'SELECT doc_id, phrase, "offset", "end" FROM ({_EXACT})')
def exact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir).select("doc_id", "phrase", "offset", "end")


@query(f"SELECT phrase, count(*) AS matches, count(DISTINCT doc_id) AS docs FROM ({_EXACT}) GROUP BY phrase")
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir).groupBy("phrase").agg(F.count("*").alias("matches"), F.count_distinct("doc_id").alias("docs"))


@query(f"""SELECT doc_id, phrase, len(string_split(text, phrase)) - 1 AS matches FROM documents, (SELECT unnest({_list(PHRASES)}) AS phrase) WHERE contains(text, phrase)""")
def phrases_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = phrase_search.exact_matches(table(spark, sf_dir, "documents"), PhraseModel(PHRASES), {"use_word_boundaries": False})
    return m.groupBy("doc_id", "phrase").agg(F.count("*").alias("matches"))


@query(f"""
WITH e AS ({_EXACT}), r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "offset", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN "offset" > coalesce(reach, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "offset", "end") AS run FROM r)
SELECT doc_id, min("offset") AS start, max("end") AS "end", array_to_string(list_sort(list_distinct(list(phrase))), '|') AS phrases FROM g GROUP BY doc_id, run""")
def known_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_search.merged_ranges(_exact(spark, sf_dir)).select("doc_id", "start", "end", F.array_join("phrases", "|").alias("phrases"))


@query(f"""
WITH e AS MATERIALIZED (SELECT doc_id, phrase, "offset", "end" FROM ({_EXACT})), b AS MATERIALIZED (SELECT *, unnest(range("offset" // 256, ("end" - 1) // 256 + 1)) AS k FROM e)
SELECT x.doc_id, x.phrase AS left_phrase, x."offset" AS left_offset, y.phrase AS right_phrase, y."offset" AS right_offset
FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.k = y.k AND x."offset" < y."end" AND y."offset" < x."end" AND x.phrase < y.phrase AND x.k = greatest(x."offset", y."offset") // 256""")
def overlapping_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _exact(spark, sf_dir)
    pairs = phrase_search.overlapping(m, m).where("left.phrase < right.phrase")
    return pairs.select("left.doc_id", F.col("left.phrase").alias("left_phrase"), F.col("left.offset").alias("left_offset"), F.col("right.phrase").alias("right_phrase"), F.col("right.offset").alias("right_offset"))


@query()
def combined_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, and fuzzy ones where no exact match of the phrase starts; of those with the same span the most similar."""
    docs, model = table(spark, sf_dir, "documents"), PhraseModel(MODEL)
    fuzzy = phrase_search.search_phrases(docs, model, {"include_variants": True, "skip_exact_matching": True, "allow_overlapping_matches": True})
    both = phrase_search.combine(phrase_search.exact_matches(docs, model, {"include_variants": True}), fuzzy)
    return phrase_search.best_of_same_span(both).select("doc_id", "phrase", "variant", "offset", "end", F.round("levenshtein_similarity", 6).alias("score"), "is_exact")


@query(f"""
SELECT doc_id, phrase, "offset", greatest("offset" - 20, 0) AS context_start, least("end" + 30, length(text)) AS context_end,
  substr(text, greatest("offset" - 20, 0)::INT + 1, least("end" + 30, length(text))::INT - greatest("offset" - 20, 0)::INT) AS context FROM ({_EXACT})""")
def match_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context.add_context(_exact(spark, sf_dir), table(spark, sf_dir, "documents"), 20, 30)
    return c.select("doc_id", "phrase", "offset", F.col("context_start").cast("long").alias("context_start"), F.col("context_end").cast("long").alias("context_end"), "context")


@query(f'SELECT doc_id::VARCHAR AS doc_id, phrase, phrase AS string, "offset", "end", 1.0::DOUBLE AS levenshtein_similarity FROM ({_EXACT})')
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = io.from_json(io.to_json(_exact(spark, sf_dir)))
    return m.select("doc_id", "phrase", "string", F.col("offset").cast("long").alias("offset"), F.col("end").cast("long").alias("end"), "levenshtein_similarity")


@query()
def fuzzy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_search.search_phrases(table(spark, sf_dir, "documents"), PhraseModel(MODEL), {"include_variants": True, "filter_distractors": True})


@query("""
SELECT doc_id, item_id, i - 1 AS "offset" FROM (SELECT doc_id, item_id, d.text, b.text AS phrase, unnest(range(1, length(d.text) - length(b.text) + 2)) AS i FROM documents d JOIN (SELECT text, min(item_id) AS item_id FROM benchmark WHERE text <> '' GROUP BY text) b ON contains(d.text, b.text))
WHERE substr(text, i::INT, length(phrase)) = phrase""")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the benchmark table, wherever it stands in a document; a table of any size."""
    items = table(spark, sf_dir, "benchmark").where("text is not null and text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    m = phrase_search.search_slices(table(spark, sf_dir, "documents"), items, lambda d, model: phrase_search.exact_matches(d, model, {"use_word_boundaries": False}), "text")
    return m.join(items, m["phrase"] == items["text"]).select("doc_id", "item_id", F.col("offset").cast("long").alias("offset"))


@query()
def fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items with up to three characters more or less and other errors."""
    config = {"levenshtein_threshold": 0.8, "ngram_threshold": 0.7, "char_match_threshold": 0.8, "skipgram_threshold": 0.8, "max_length_variance": 3}
    return phrase_search.search_slices(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), lambda d, model: phrase_search.search_phrases(d, model, config), "text")


@query()
def fuzzy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_search.search_tokens(table(spark, sf_dir, "documents"), PhraseModel(MODEL))


@query()
def fuzzy_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.search_context(table(spark, sf_dir, "documents"), PhraseModel(MODEL), {"context_size": 40})


@query()
def web_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.to_web_annotations(fuzzy_contexts(spark, sf_dir))


@query()
def template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = PhraseModel(MODEL)
    return templates.search_templates(table(spark, sf_dir, "documents"), Template.parse(TEMPLATE, model), model)


_ROLE = "CASE phrase WHEN 'of the' THEN 'a' WHEN 'in the' THEN 'b' ELSE 'c' END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_ROLE} AS label FROM ({_EXACT})) WHERE label IN ('a', 'b') GROUP BY doc_id HAVING count(DISTINCT label) = 2")
def required_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _exact(spark, sf_dir).withColumn("labels", F.array(F.expr(_ROLE)))
    t = Template.parse([{"label": "a", "required": True}, {"label": "b", "required": True}, {"label": "c"}])
    return templates.required_documents(m, t)


@query(f"""
WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), p AS (SELECT DISTINCT unnest(string_split(x, ' ')) AS token FROM (SELECT unnest({_list(TARGETS)}) AS x)),
g AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE substr(term, i::INT + 1, 1) || substr(term, i::INT + 1 + d, 1) END AS sg FROM t, unnest(range(0, length(term))) u(i), (VALUES (1), (2), (3)) v(d) WHERE length(term) <= 2 OR i + d < length(term)),
h AS (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE substr(token, i::INT + 1, 1) || substr(token, i::INT + 1 + d, 1) END AS sg FROM p, unnest(range(0, length(token))) u(i), (VALUES (1), (2), (3)) v(d) WHERE length(token) <= 2 OR i + d < length(token))
SELECT DISTINCT term, token, CASE WHEN length(term) <= 3 AND levenshtein(term, token) = abs(length(term) - length(token)) THEN NOT contains(token, term) ELSE levenshtein(term, token) - abs(length(term) - length(token)) > 2 END AS is_distractor
FROM g JOIN h USING (sg)""")
def vocabulary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    toks = spark.createDataFrame([(w,) for x in TARGETS for w in x.split()], "token string")
    return token_search.token_pairs(terms, toks)


# --- corpus statistics ---


def _docs_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", frequencies.words("text").alias("tokens"))


_FULL = f"list_concat(list_concat(['<s>', '<s>'], {_WORDS}), ['</s>', '</s>'])"
_NGRAMS = f"""
WITH w AS (SELECT {_WORDS} AS t FROM documents), g AS (
  SELECT 1 AS n, unnest(t) AS ngram FROM w
  UNION ALL SELECT 2, unnest(list_transform(range(1, len(f)), lambda i: f[i] || ' ' || f[i + 1])) FROM (SELECT list_concat(list_concat(['<s>'], t), ['</s>']) AS f FROM w)
  UNION ALL SELECT 3, unnest(list_transform(range(1, len(f) - 1), lambda i: f[i] || ' ' || f[i + 1] || ' ' || f[i + 2])) FROM (SELECT list_concat(list_concat(['<s>', '<s>'], t), ['</s>', '</s>']) AS f FROM w)),
c AS (SELECT n, ngram, count(*) AS freq FROM g GROUP BY n, ngram)"""


@query(f"{_NGRAMS} SELECT n, ngram, freq FROM c")
def ngram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.count_ngrams(_docs_words(spark, sf_dir), "tokens", 3)


@query(f"{_NGRAMS} SELECT n, sum(freq)::BIGINT AS total_tokens, count(*) AS total_types FROM c GROUP BY n")
def ngram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.totals(ngram_frequencies(spark, sf_dir))


_MARKS = "CASE WHEN regexp_full_match({g}, '<s>( <s>)*|</s>( </s>)*') THEN (SELECT count(*) FROM documents) ELSE coalesce({f}, 0) END"


@query(f"""{_NGRAMS}, one AS (SELECT sum(freq) AS t, count(*) AS v FROM c WHERE n = 1), q AS (SELECT ngram, {_MARKS.format(g="ngram", f="freq")} AS f1, regexp_replace(ngram, ' [^ ]*$', '') AS head FROM c WHERE n = 2)
SELECT q.ngram, round((f1 + 0.5) / ({_MARKS.format(g="head", f="h.freq")} + 0.5 * v), 9) AS prob FROM q LEFT JOIN c h ON h.ngram = q.head AND h.n = 1, one""")
def bigram_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs_words(spark, sf_dir)
    grams = stored(frequencies.count_ngrams(docs, "tokens", 2))
    out = frequencies.counted_conditionals(grams, 2, docs.count(), "laplace", k=0.5)
    return out.select("ngram", F.round("prob", 9).alias("prob"))


@query(f"""{_NGRAMS}, t AS (SELECT n, sum(freq) AS total FROM c GROUP BY n)
SELECT c.n, ngram, round(freq / total, 12) AS prob, round((freq + 1) / (total + (SELECT count(*) FROM c WHERE n = 1)), 12) AS smoothed FROM c JOIN t USING (n)""")
def ngram_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = stored(ngram_frequencies(spark, sf_dir))
    plain = frequencies.probabilities(grams, grams.select("ngram", "freq")).withColumnRenamed("prob", "plain")
    both = frequencies.probabilities(grams, plain, "laplace")
    return both.select(F.col("n").cast("int").alias("n"), "ngram", F.round("plain", 12).alias("prob"), F.round("prob", 12).alias("smoothed"))


@query(f"""{_NGRAMS}, one AS (SELECT sum(freq) AS t FROM c WHERE n = 1), q AS (SELECT ngram, freq, w[1] || ' ' || w[2] AS h2, w[2] || ' ' || w[3] AS t2, w[2] AS h1, w[3] AS t1 FROM (SELECT ngram, freq, string_split(ngram, ' ') AS w FROM c WHERE n = 3)),
f AS (SELECT q.ngram, q.freq AS f3, {_MARKS.format(g="h2", f="a.freq")} AS fh2, {_MARKS.format(g="t2", f="b.freq")} AS ft2, {_MARKS.format(g="h1", f="d.freq")} AS fh1, {_MARKS.format(g="t1", f="e.freq")} AS ft1
  FROM q LEFT JOIN c a ON a.n = 2 AND a.ngram = h2 LEFT JOIN c b ON b.n = 2 AND b.ngram = t2 LEFT JOIN c d ON d.n = 1 AND d.ngram = h1 LEFT JOIN c e ON e.n = 1 AND e.ngram = t1)
SELECT ngram, round(CASE WHEN fh2 > 0 THEN 0.6 * f3 / fh2 ELSE 0 END + CASE WHEN fh1 > 0 THEN 0.3 * ft2 / fh1 ELSE 0 END + 0.1 * ft1 / t, 9) AS prob FROM f, one""")
def interpolated_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs_words(spark, sf_dir)
    grams = stored(frequencies.count_ngrams(docs, "tokens", 3))
    out = frequencies.counted_conditionals(grams, 3, docs.count(), "interpolation", [0.6, 0.3, 0.1])
    return out.select("ngram", F.round("prob", 9).alias("prob"))


def _freq(df: DataFrame) -> DataFrame:
    return df.select(F.explode(frequencies.words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def _g2(a: str, b: str, t1: str, t2: str) -> str:
    cells = [(a, f"({a} + {b}) * {t1} / ({t1} + {t2})"), (b, f"({a} + {b}) * {t2} / ({t1} + {t2})"), (f"({t1} - {a})", f"({t1} + {t2} - {a} - {b}) * {t1} / ({t1} + {t2})"), (f"({t2} - {b})", f"({t1} + {t2} - {a} - {b}) * {t2} / ({t1} + {t2})")]
    return "2 * (" + " + ".join(f"{o} * ln(({o} + 1e-20) / ({e} + 1e-20))" for o, e in cells) + ")"


def _two(first: str, second: str) -> str:
    f = lambda s: f"SELECT token, count(*)::DOUBLE AS freq FROM (SELECT unnest({_WORDS}) AS token FROM {s}) GROUP BY token"
    return f"""WITH x AS ({f(first)}), y AS ({f(second)}), b AS (SELECT coalesce(x.token, y.token) AS token, coalesce(x.freq, 0) AS a, coalesce(y.freq, 0) AS b, (SELECT sum(freq) FROM x) AS t1, (SELECT sum(freq) FROM y) AS t2 FROM x FULL JOIN y ON x.token = y.token)"""


@query(f"""{_two("documents JOIN labels USING (doc_id) WHERE toxic = 1", "documents JOIN labels USING (doc_id) WHERE toxic = 0")}
SELECT token, a::BIGINT AS f1, b::BIGINT AS f2, round({_g2("a", "b", "t1", "t2")}, 4) AS llr, CASE WHEN a > (a + b) * t1 / (t1 + t2) THEN 'more' ELSE 'less' END AS direction, round(CASE WHEN b = 0 THEN 'inf'::DOUBLE ELSE (a / t1 - b / t2) / (b / t2) END, 6) AS diff FROM b""")
def keyword_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = frequencies.compare(_freq(d.where("toxic = 1")), _freq(d.where("toxic = 0")))
    return out.select("token", "f1", "f2", F.round("llr", 4).alias("llr"), "direction", F.round("diff", 6).alias("diff"))


@query(f"""{_two("conversations WHERE role = 'user'", "conversations WHERE role <> 'user'")},
d AS (SELECT token, a, b, CASE WHEN b = 0 THEN 1e4 ELSE (a / t1 - b / t2) / (b / t2) END AS d1, CASE WHEN a = 0 THEN 1e4 ELSE (b / t2 - a / t1) / (a / t1) END AS d2 FROM b WHERE a >= 5 OR b >= 5)
SELECT token, a::BIGINT AS f1, b::BIGINT AS f2, round(d1, 6) AS perc_diff1, round(d2, 6) AS perc_diff2, CASE WHEN d1 > 5 THEN 'disappear' WHEN d1 > 0.5 THEN 'decrease' WHEN d2 > 5 THEN 'emerge' WHEN d2 > 0.5 THEN 'increase' END AS level
FROM d WHERE d1 > 0.5 OR d2 > 0.5""")
def spelling_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    diff = frequencies.spelling_diff(_freq(c.where("role = 'user'")), _freq(c.where("role <> 'user'")))
    frequent = diff.join(frequencies.frequent_words(diff, min_freq=5), "token")
    return frequencies.change_levels(frequent).select("token", "f1", "f2", F.round("perc_diff1", 6).alias("perc_diff1"), F.round("perc_diff2", 6).alias("perc_diff2"), "level")


@query(f"""
WITH l AS (SELECT token, level FROM ({SQL["spelling_changes"]})), r AS (SELECT token, level, row_number() OVER (ORDER BY token) - 1 AS vec_id FROM l),
v AS (SELECT token, level, embedding::DOUBLE[] AS x FROM r LEFT JOIN embeddings USING (vec_id)),
d AS (SELECT * FROM v WHERE level IN ('disappear', 'decrease')), u AS (SELECT * FROM v WHERE level IN ('emerge', 'increase')),
k AS (SELECT d.token AS "drop", u.token AS jump, d.level AS drop_level, u.level AS jump_level, CASE WHEN d.level = 'disappear' THEN 'replace' ELSE 'shift' END AS change FROM d JOIN u ON list_cosine_similarity(d.x, u.x) > 0.5)
SELECT * FROM k UNION ALL SELECT token, NULL, level, NULL, level FROM d WHERE token NOT IN (SELECT "drop" FROM k) UNION ALL SELECT NULL, token, NULL, level, level FROM u WHERE token NOT IN (SELECT jump FROM k)""")
def linked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed words linked by their vectors; the tables have none for words, so the embedding of a word's place among them stands for it."""
    levels = stored(spelling_changes(spark, sf_dir).select("token", "level"))
    terms = vocabularies.vocabulary(levels.select(F.col("token").alias("term"), F.col("token").alias("o")), order="o")
    vectors = terms.join(table(spark, sf_dir, "embeddings"), F.col("id") == F.col("vec_id")).select(F.col("term").alias("token"), F.col("embedding").alias("vector"))
    return frequencies.linked_changes(levels, vectors, 0.5)


@query(f"""
WITH w AS (SELECT {_WORDS} AS t FROM conversations)
SELECT term1, term2, count(*) AS freq FROM (SELECT unnest(list_transform(range(1, len(t) - d + 1), lambda i: t[i])) AS term1, unnest(list_transform(range(1, len(t) - d + 1), lambda i: t[i + d])) AS term2 FROM w, (VALUES (1), (2), (3)) v(d) WHERE len(t) > d) GROUP BY term1, term2""")
def skip_cooccurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.cooccurrences(table(spark, sf_dir, "conversations").select(frequencies.words("text").alias("tokens")), "tokens", 2)


@query("SELECT term, row_number() OVER (ORDER BY first, term) - 1 AS id FROM (SELECT lower(p_name) AS term, min(p_partkey) AS first FROM part GROUP BY lower(p_name))")
def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabularies.vocabulary(table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), "p_partkey"), order="p_partkey", ignorecase=True)


@query()
def near_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of all distinct words, however rare."""
    k = _freq(table(spark, sf_dir, "conversations")).select(F.col("token").alias("keyword"))
    return vocabularies.close_keywords(k, max_distance=3, max_ratio=0.3).withColumn("distance", F.col("distance").cast("long"))


_PART_PAIRS = """SELECT x.s AS a, y.s AS b, levenshtein(x.s, y.s) AS distance FROM (SELECT DISTINCT p_name AS s FROM part) x JOIN (SELECT DISTINCT p_name AS s FROM part) y ON x.s < y.s
  WHERE levenshtein(x.s, y.s) < 6 AND (levenshtein(x.s, y.s) / length(x.s) < 0.5 OR levenshtein(x.s, y.s) / length(y.s) < 0.5)"""


@query(f"""WITH p AS ({_PART_PAIRS}), two AS (SELECT a AS term, b AS other, distance FROM p UNION ALL SELECT b, a, distance FROM p)
SELECT term, other, distance FROM (SELECT *, min(distance) OVER (PARTITION BY term) AS least FROM two) WHERE distance = least""")
def closer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vocabularies.close_keywords(table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword")), max_distance=6, max_ratio=0.5)
    return vocabularies.closer_terms(stored(pairs)).withColumn("distance", F.col("distance").cast("long"))


_SIMILAR = """
WITH t AS (SELECT DISTINCT p_name AS term FROM part), g AS (SELECT term, substr(term, i::INT + 1, 1) || substr(term, i::INT + 1 + d, 1) AS sg FROM t, unnest(range(0, length(term) - 1)) u(i), (VALUES (1), (2), (3)) v(d) WHERE i + d < length(term)),
c AS (SELECT term, sg, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT term, sqrt(sum(f * f)) AS norm FROM c GROUP BY term),
s AS (SELECT a.term AS query, b.term AS term, sum(a.f * b.f) AS dot FROM c a JOIN c b USING (sg) WHERE abs(length(a.term) - length(b.term)) <= 2 GROUP BY a.term, b.term),
r AS (SELECT query, s.term, round(dot / (x.norm * y.norm), 6) AS score FROM s JOIN n x ON x.term = query JOIN n y ON y.term = s.term)"""


def _part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(vocabularies.skipgram_index(table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))))


@query(f"{_SIMILAR} SELECT * FROM r WHERE score >= 0.3")
def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the index as a query."""
    index = _part_index(spark, sf_dir)
    s = vocabularies.similarities(index, index, 2).select("query", "term", F.round("score", 6).alias("score"))
    return s.where("score >= 0.3")


@query(f"{_SIMILAR} SELECT query, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, term) AS rank FROM r WHERE score >= 0.5) WHERE rank <= 5")
def most_similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar terms of every term: the limit is the feature."""
    index = _part_index(spark, sf_dir)
    found = vocabularies.rank_similar(index, index, top_n=5, score_cutoff=0.5)
    return found.select("query", "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH t AS (SELECT token, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS token FROM conversations) GROUP BY token), s AS (SELECT freq, list_append(string_split(token, ''), ' ') AS y FROM t)
SELECT "left", "right", sum(freq)::BIGINT AS freq FROM (SELECT freq, unnest(list_distinct(list_transform(range(1, len(y)), lambda i: {{'left': y[i], 'right': y[i + 1]}})), recursive := true) FROM s) GROUP BY "left", "right\"""")
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabularies.pair_counts(vocabularies.bpe_tokens(table(spark, sf_dir, "conversations").select(F.explode(frequencies.words("text")).alias("token"))))


@query()
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabularies.byte_pair_encoding(table(spark, sf_dir, "conversations").select(F.explode(frequencies.words("text")).alias("token")), 10)[1]


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(\d{4})', 1)) AS n, array_to_string(regexp_extract_all(html, '(\d{4})', 1), ',') AS years FROM pages""")
def year_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = patterns.PATTERNS["year"].extract("html")[0]
    return table(spark, sf_dir, "pages").select("page_id", F.size(years).cast("long").alias("n"), F.array_join(years, ",").alias("years"))


def _finds(p: patterns.Pattern) -> str:
    return " || '; ' || ".join(f"array_to_string(regexp_extract_all(html, '{p.pattern.replace(chr(39), chr(39) * 2)}', {g}), ',')" for g in p.groups)


@query(" UNION ALL ".join(f"SELECT page_id, '{name}' AS pattern, len(regexp_extract_all(html, '{p.pattern.replace(chr(39), chr(39) * 2)}', 0)) AS n, {_finds(p)} AS finds FROM pages" for name, p in patterns.PATTERNS.items()))
def all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of every pattern in every page, groups apart."""
    out = []
    for name, p in patterns.PATTERNS.items():
        got = p.extract("html")
        out.append(F.struct(F.lit(name).alias("pattern"), F.size(got[0]).cast("long").alias("n"), F.concat_ws("; ", *[F.array_join(g, ",") for g in got]).alias("finds")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*out)).alias("x")).select("page_id", "x.*")
