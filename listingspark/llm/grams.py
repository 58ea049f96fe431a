"""Character n-grams of many texts at once, hashed in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SPACE = 32
#: Code points of text that are handled at once; longer texts are cut at white space.
CHUNK = 1 << 19
#: Code points that consecutive parts of a long text share.
OVERLAP = 256


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a space at either end, all white space as spaces; where each begins."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), dtype=np.uint32)
    space = (points <= SPACE) & ((points == SPACE) | ((points >= 9) & (points <= 13))) | (points == 0xA0)
    begins = np.zeros(len(padded) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in padded], out=begins[1:])
    return np.where(space, np.uint32(SPACE), points), begins


def room(points: np.ndarray) -> np.ndarray:
    """At each position, the length of the longest run from there that has spaces at its ends only."""
    size = len(points)
    spaces = np.flatnonzero(points == SPACE)
    after = np.searchsorted(spaces, np.arange(size), side="right")  # the first space behind each position
    ends = np.append(spaces, size - 1)[np.minimum(after, len(spaces))]
    return (ends - np.arange(size) + 1).astype(np.int32)


def gram_hashes(points: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n, a 32-bit hash of the n code points from each position on."""
    rolled = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(lengths) + 1):
        if len(points) < n:
            return
        rolled = rolled[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(1)
        if n in lengths:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield n, (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x9E3779B1)


def text_groups(texts: Sequence[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Parts of the texts in groups of about ``CHUNK`` code points, and the text each part is of; null counts as empty.

    A long text gives several parts, cut at white space where there is some; each begins ``OVERLAP`` code points
    before the last one's end, again at white space.
    """
    group: list[str] = []
    owner: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for part in _parts(text or ""):
            if held and held + len(part) > CHUNK:
                yield group, owner
                group, owner, held = [], [], 0
            group.append(part)
            owner.append(i)
            held += len(part)
    if group:
        yield group, owner


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + CHUNK // 2, at + CHUNK)
        end = cut if cut > 0 else at + CHUNK
        yield text[at:end]
        back = text.find(" ", end - OVERLAP, end)
        at = back if back > at else end
    yield text[at:]
