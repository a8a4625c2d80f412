import zlib
from collections import defaultdict

import numpy as np

from marginalia.llm import packing
from marginalia.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, length long, start string"


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def check(rows, want):
    """Every id in one piece; sequences gapless, at most 1024."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / sum(len(x) for x in want.values())


def test_round_trip_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, library_ids(texts.values())))
    assert check(packing.op4_harmonic_packing(spark, sf_dir).collect(), want) < 0.02


def test_odd_texts(spark):
    odd = [None, "", " ", "x", "\n\n \t", "<|endoftext|> a<|endoftext|>", "é" * 5000, "a" * 30000, " " * 20000 + "b", "word " * 9000, "日本語 🙂 ñ\x00\x01", "it's don't I'LL 12345 ___"]
    rows = [(i, t, 1, "s") for i, t in enumerate(odd)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    check(out, dict(zip(range(len(odd)), library_ids(odd))))


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).collect() == []
    twice = spark.createDataFrame([(7, "a b c", 1, "s")] * 2, SCHEMA)
    assert len(packing.pack(twice.coalesce(1)).collect()) == 2


def test_cuts():
    for n in range(1, 5000):
        assert sum(packing.cuts(n)) == n and all(x == 1024 or x in (512, 256, 128) or x < 128 for x in packing.cuts(n))
