"""Packing: documents end to end, cut into windows of a fixed number of tokens.

First pass: every task tokenizes its rows, ends each document with the closing id and writes ids, along with the
task's number and the tokens it had written before, to a table in the shared folder. The tasks' totals, one number
for each, add up to where each task's tokens begin in the whole sequence. Second pass: a document's place in the
whole is its task's begin plus its own; its pieces are cut where windows end. A piece that begins or ends inside its
document is a boundary record (``cut_before``, ``cut_after``). No token moves between tasks in either pass.

Ids are those of the ``tokenizers`` file of the given name. Byte-level BPE never merges across a space before a
non-space, so texts are split there and each different part is tokenized once and kept in a bounded cache, with the
same vocabulary in ``tiktoken`` form, which is faster on short parts.

Defined cases: a null or empty text gives the closing id alone; equal rows each get their own pieces; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .texts import own_columns, written

TOKENIZER = "byte_bpe_50k"
WINDOW = 2048
CLOSING_ID = 1
#: Different parts of text whose ids a worker keeps; beyond, the cache starts anew.
CACHE_PARTS = 400_000
#: Bytes of ids in one output batch.
BATCH_BYTES = 4 << 20

_SPLIT = re.compile(r" (?=\S)")
_WIDE = re.compile(r" (?=\s)|^\s|\s$")


class PartCache(dict):
    """Ids of parts of text, as little-endian 16-bit or 32-bit numbers."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        ids = self[part] = self.whole(" " + part)
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype=self.kind).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a whole text: of what comes before its first splitting space, and of each part from there on."""
        first, *rest = text.split(" ") if not _WIDE.search(text) else _SPLIT.split(text)
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(2)
def part_cache(name: str) -> PartCache:
    return PartCache(name)


@lru_cache(2)
def special_tokens(name: str):
    """The tokenizer itself and its special strings: a text that has one of them goes through it, to get its id."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    return whole, [t.content for t in whole.get_added_tokens_decoder().values()]


def token_bytes(text: str | None, name: str = TOKENIZER) -> bytes:
    """Ids of a text as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
    text = text or ""
    whole, special = special_tokens(name)
    cache = part_cache(name)
    if any(s in text for s in special):
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=cache.kind).tobytes()
    return cache.ids(text)


def tokenized(docs: DataFrame, name: str, closing: int) -> DataFrame:
    """``part, before, doc_id, ids`` of every row: the task, the tokens it wrote before, and the ids with the closing one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([closing], dtype=part_cache(name).kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [token_bytes(t, name) + end for t in some.column(1).to_pylist()]
                lengths = np.array([len(x) // len(end) for x in ids], dtype=np.int64)
                starts = before + np.concatenate(([0], np.cumsum(lengths)[:-1]))
                before += int(lengths.sum())
                yield pa.record_batch(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts, pa.int64()), some.column(0), pa.array(lengths), pa.array(ids, pa.binary())],
                    ["part", "before", "doc_id", "tokens", "ids"],
                )

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "part int, before bigint, doc_id bigint, tokens bigint, ids binary")


def packed(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, closing: int = CLOSING_ID) -> DataFrame:
    """The pieces: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, cut_before, cut_after``.

    ``ids`` are little-endian unsigned 32-bit numbers. All sequences are full but the last.
    """
    rows = written(tokenized(docs, tokenizer, closing), "tokens")
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("n")).collect()  # one number for each task of the first pass
    begins = np.zeros(max((t.part for t in totals), default=0) + 2, dtype=np.int64)
    for t in totals:
        begins[t.part + 1] = t.n
    shared = docs.sparkSession.sparkContext.broadcast(np.cumsum(begins))
    kind = part_cache(tokenizer).kind.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for part, before, doc, tokens, ids in zip(*(batch.column(i) for i in range(5)), strict=True):
                tokens, first = tokens.as_py(), int(base[part.as_py()]) + before.as_py()
                ids = np.frombuffer(ids.as_buffer(), dtype=kind).astype("<u4")
                at = 0
                while at < tokens:
                    sequence, offset = divmod(first + at, window)
                    length = min(window - offset, tokens - at)
                    out.append((doc.as_py(), at, length, ids[at : at + length].tobytes(), tokens, sequence, offset, at > 0, at + length < tokens))
                    at, held = at + length, held + 4 * length + 64
                    if held >= BATCH_BYTES:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return rows.select("part", "before", "doc_id", "tokens", "ids").mapInArrow(run, PIECES)


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, cut_before boolean, cut_after boolean"
_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in PIECES.split(", ")]
    return pa.record_batch([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])
