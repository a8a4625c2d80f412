"""Harmonic packing of token sequences into training sequences.

Lengths fall into reciprocal-capacity classes: a piece of length n is of class capacity // n and a bin of that class takes
exactly so many pieces. Classes are filled independently of each other and of other workers, so packing is one narrow,
shuffle-free stage. Cutting is free, so before classing a document gives up whole sequences of `capacity` and then pieces of
capacity/2, /4, /8 exactly (bins of these have no padding); only the tail below capacity/8 lands in the coarser harmonic
classes, whose bins leave at most 1/9 of their room. What a worker has in open bins at its end is laid end to end, cut at
`capacity`, and the last sequence is cut into powers of two, which need no padding.

Nulls: a null text is an empty one; every document has its end id, so it has at least one piece. A null id stays null.
Repeated rows are packed as often as they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import as_str, table, tokenizer_path

CAPACITY = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The pre-tokenising pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids as the tokenizers library gives them for the vocabulary at path, without special tokens added.

    A faster implementation of the same merges encodes ordinary texts; texts that name a special token, and any it can't
    take, go through the library itself.
    """

    def __init__(self, path: str):
        self.path, self._slow = path, None
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._fast = None
        pre = json.dumps(spec.get("pre_tokenizer"))
        if spec["model"]["type"] == "BPE" and '"ByteLevel"' in pre and '"add_prefix_space": true' not in pre and not spec.get("normalizer"):
            import tiktoken

            units = {c: b for b, c in byte_units().items()}
            ranks = {bytes(units[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            order = sorted(ranks.values()) == list(range(len(ranks)))
            if order and self._merges_follow_ids(spec["model"]):
                self._fast = tiktoken.Encoding("marginalia", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _merges_follow_ids(model: dict) -> bool:
        """Whether merge priority equals id order, which the fast implementation assumes."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        return all(a < b for a, b in zip(ids, ids[1:]))

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self._fast is None or any(s in text for s in self.special):
            return self.slow(text)
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as e:  # the Rust side panics on what its regex engine gives up on
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.slow(text)


def byte_units() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of n tokens: whole sequences, exact halves to eighths, then the tail."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for k in (2, 4, 8):
        if n >= capacity // k:
            out.append(capacity // k)
            n -= capacity // k
    return out + [n] * (n > 0)


class Packer:
    """One worker's open bins. add() returns the rows of bins that it completes."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, first_id, {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start, total = 0, len(ids)
        for n in cuts(total, self.capacity):
            per_bin = self.capacity // n
            bin_ = self.open.setdefault(per_bin, [])
            bin_.append((doc, start, ids[start : start + n].copy(), total))
            start += n
            if len(bin_) == per_bin:
                yield from self._close(self.open.pop(per_bin))

    def finish(self) -> Iterator[tuple]:
        """Open bins end to end; the last, short sequence in powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        room, bin_ = self._room(left), []
        for doc, start, ids, total in rest:
            while len(ids):
                n = min(len(ids), room)
                bin_.append((doc, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    yield from self._close(bin_)
                    room, bin_ = self._room(left), []

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """A row per piece (see SCHEMA). sequence_id is the partition's number times 2**33 plus a counter, so a task that runs again gives the same ids."""
    path = tokenizer_path(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = Encoder(path), []
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in it:
            for doc, text in zip(b.column(0).to_pylist(), as_str(b, b.schema.names[1])):
                ids = encode(text)
                ids.append(end_id)
                rows.extend(packer.add(doc, np.array(ids, "<u4")))
            if len(rows) > 20000:
                yield out()
        rows.extend(packer.finish())
        if rows:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_harmonic_packing": op4_harmonic_packing}
SQL: dict[str, str] = {}
