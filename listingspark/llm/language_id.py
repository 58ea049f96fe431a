"""Language identification by language-bitmask n-gram filters.

The character n-grams that are frequent in a language's texts go into its Bloom filter. All filters share their hash
functions and are stored bit-sliced: a slot holds one bit per language, so the bitwise AND of an n-gram's slots names
every language that contains it. Counting bits over a text gives, per language, the share of its n-grams in that
filter; the share that a filter of its fill would find by accident is taken out, and the highest share decides.

The filters are fitted on at most ``SAMPLE_DOCS`` labelled texts of at most ``SAMPLE_CHARS`` code points, an even part
for each language, those with the smallest hash of their id; each filter keeps the ``KEEP`` most frequent n-grams.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be
learnt; equal rates go to the language with more sampled texts, then to the first by name; equal texts get equal
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .grams import code_points, gram_hashes, room, text_groups
from .texts import own_columns

LENGTHS = (2, 3, 4)
SLOTS_BITS = 18
HASHES = 3
KEEP = 12_000
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 12_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


def _letter_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with everything but letters as spaces, where texts begin, and whether each point is a letter."""
    points, begins = code_points(texts)
    letter = _letters()[points]
    return np.where(letter, points, np.uint32(32)), begins, letter


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The slots of each n-gram: two hashes, combined."""
    step = ((hashes ^ (hashes >> np.uint32(16))) * np.uint32(0x85EBCA6B)) | np.uint32(1)
    for _ in range(HASHES):
        yield hashes >> np.uint32(32 - SLOTS_BITS)
        hashes = hashes + step


@dataclass(frozen=True)
class LanguageFilters:
    """``masks[slot, word]`` holds 64 languages' bits a word; ``accident`` the rate at which each filter finds what it lacks."""

    languages: list[str]
    masks: np.ndarray
    accident: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> LanguageFilters:
        count = {x: languages.count(x) for x in set(languages)}
        names = sorted(count, key=lambda x: (-count[x], x))  # the order that ties go by
        masks = np.zeros((1 << SLOTS_BITS, max(1, -(-len(names) // 64))), dtype=np.uint64)
        fill = np.zeros(len(names))
        for k, name in enumerate(names):
            own = np.unique(_frequent([t for t, x in zip(texts, languages, strict=True) if x == name]))
            bit, word = np.uint64(1 << (k % 64)), k // 64
            for slot in _slots(own):
                masks[slot, word] |= bit
            fill[k] = float(((masks[:, word] & bit) != 0).mean())
        return cls(names, masks, fill**HASHES)

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams per text and language, and whether each text has a letter."""
        hits, total, lettered = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for parts, owners in text_groups(texts):
            points, begins, letter = _letter_points(parts)
            space = room(points)
            owners = np.array(owners)
            for n, hashes in gram_hashes(points, LENGTHS):
                at = np.flatnonzero((space[: len(hashes)] >= n) & (letter[: len(hashes)] | letter[1 : len(hashes) + 1]))
                owner = owners[np.searchsorted(begins, at, side="right") - 1]
                total += np.bincount(owner, minlength=len(texts))
                found = None
                for slot in _slots(hashes[at]):
                    found = self.masks[slot] if found is None else found & self.masks[slot]
                for k in range(len(self.languages)):
                    hits[:, k] += np.bincount(owner, (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), len(texts))
            seen = np.flatnonzero(letter)
            lettered[owners[np.unique(np.searchsorted(begins, seen, side="right") - 1)]] = True
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.accident) / np.maximum(1 - self.accident, 1e-9), 0, 1), lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rates, lettered = self.rates(texts)
        best, sums = rates.argmax(axis=1), rates.sum(axis=1)
        score = np.where(lettered & (sums > 0), rates.max(axis=1) / np.maximum(sums, 1e-12), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score


def _frequent(texts: list[str]) -> np.ndarray:
    """Hashes of the most frequent n-grams; ties go to the smaller hash."""
    found: list[np.ndarray] = []
    for parts, _ in text_groups(texts):
        points, _, letter = _letter_points(parts)
        space = room(points)
        for n, hashes in gram_hashes(points, LENGTHS):
            found.append(hashes[(space[: len(hashes)] >= n) & (letter[: len(hashes)] | letter[1 : len(hashes) + 1])])
    own, many = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
    return own[np.argsort(-many, kind="stable")[:KEEP]]


def sample(docs: DataFrame, usable: Column) -> tuple[list[str], list[str]]:
    """The bounded training sample: texts and languages."""
    known = own_columns(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & usable & F.col("text").isNotNull())
    ids = known.filter(F.length("text") <= SAMPLE_CHARS).select("lang", "doc_id")
    each = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("place") <= SAMPLE_DOCS)
    chosen = each.orderBy("place", "lang", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    rows = known.filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_DOCS).collect()
    return [r.text for r in rows], [r.lang for r in rows]


def identified(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.accident))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageFilters(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, score = own.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def language(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Fit on the rows of ``docs`` that have a language and are not held out, then predict every row."""
    usable = F.lit(True) if held_out is None else ~held_out
    return identified(docs, LanguageFilters.fit(*sample(docs, usable)))
