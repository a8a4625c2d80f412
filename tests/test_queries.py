"""Every registered query against its SQL, or its own second run where it has none, on the smallest tables."""

from collections import Counter

import pytest
import regex
from sql_check_rows import differences

import __spark_entry__ as entry
from marginalia import queries as own



def test_registry():
    assert set(own.SQL) <= set(own.QUERIES) and len(own.QUERIES) > 30
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_sql(spark, sf_dir, name):
    rows, more, less = differences(own.QUERIES[name](spark, sf_dir), own.SQL[name], sf_dir)
    assert not more and not less, (more, less)
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_reruns_agree(spark, sf_dir, name):
    """Queries without SQL; test_whole_queries.py has their rows."""
    rows = own.QUERIES[name](spark, sf_dir).collect()
    assert rows or name == "template_matches"
    assert sorted(map(str, rows)) == sorted(map(str, own.QUERIES[name](spark, sf_dir).collect()))


def test_byte_pair_merges(spark, sf_dir):
    """Ten merges, recounted each time."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    types = [[f, [*w, " "]] for w, f in Counter(w for t in texts for w in regex.findall(r"[\p{L}\p{N}_]+", t.lower())).items()]
    want = []
    for step in range(10):
        counts = Counter()
        for f, s in types:
            for pair in set(zip(s, s[1:])):
                counts[pair] += f
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], len(x[0][0] + x[0][1]), x[0]))
        want.append((step, a, b, n))
        for x in types:
            s, out = x[1], []
            for c in s:
                if out and out[-1] == a and c == b:
                    out[-1] = a + b
                else:
                    out.append(c)
            x[1] = out
    assert [tuple(r) for r in own.QUERIES["bpe_merges"](spark, sf_dir).orderBy("step").collect()] == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
