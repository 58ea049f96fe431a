"""What the corpus operators share: words as expressions, words as hashes in numpy, bounded samples, shared tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listingspark.session import working_folder

#: White space between words: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\f\r"
#: Bytes of text whose words are hashed at once.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, missing ones as null; further columns of a table never clash with an operator's own."""
    ids = ("doc_id", "page_id", "item_id")
    of = lambda n: F.col(f"`{n}`") if n in df.columns else F.lit(None)
    return df.select(*[of(n).cast("bigint" if n in ids else "int" if n == "toxic" else "string").alias(n) for n in names])


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends here, and no lost executor takes it along."""
    path = working_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31))
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of a splittable generator)."""
    a, b, c, d, e = _MIX
    x = (x ^ (x >> c)) * a
    x = (x ^ (x >> d)) * b
    return x ^ (x >> e)


def _byte_values() -> np.ndarray:
    lowered = np.arange(256, dtype=np.uint64)
    lowered[65:91] += np.uint64(32)
    return mix(lowered * _STEP + _STEP)


_BYTE = _byte_values()
#: Which bytes are white space.
WHITE = np.zeros(256, dtype=bool)
WHITE[[ord(c) for c in _SPACES]] = True
_SIGN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a usual chunk are kept."""
    if _POWERS and size <= CHUNK_BYTES + 1:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(size, CHUNK_BYTES + 1), base, dtype=np.uint64)
        p[:1] = 1
        made.append(np.multiply.accumulate(p))
    if size <= CHUNK_BYTES + 1:
        _POWERS[:] = made
    return made[0], made[1]


def hashed_words(data: np.ndarray, offsets: np.ndarray, plain: bool = False, places: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of consecutive texts, A-Z lower-cased, and where each text's words begin.

    ``plain`` counts all ASCII signs as white space; ``places`` adds the byte at which each word begins.

    ``data`` holds the texts' UTF-8 bytes one after the other, ``offsets`` where each begins and the last one ends.
    A word's hash is a polynomial of its bytes, read off two prefix sums, so all words cost one pass without a loop.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = len(data)
    if not size:
        none = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*none, np.zeros(0, np.int64)) if places else none
    ink = ~(_SIGN if plain else WHITE)[data]
    first = np.zeros(size + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(size, dtype=bool)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.empty(size, dtype=bool)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    power, inverse = _powers(size + 1)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:size], out=sums[1:])
    found = mix((sums[ends] - sums[starts]) * inverse[starts] + _STEP), np.searchsorted(starts, offsets)
    return (*found, starts) if places else found


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``size`` bytes (one at least): first, behind last, bytes and offsets."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, spots, data = texts.buffers()
    offsets = np.frombuffer(spots, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end, data, offsets[at : end + 1]
        at = end


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with fewer words, one of the whole sequence; without words, none."""
    if not len(hashes):
        return hashes
    span = min(size, len(hashes))
    many = len(hashes) - span + 1
    out = np.full(many, np.uint64(span), dtype=np.uint64)
    for i in range(span):
        out = mix(out * _STEP + hashes[i : i + many])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def plain_words(text: str) -> list[str]:
    return re.findall(f"[^{SPACE}]+", text or "")
