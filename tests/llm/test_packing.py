import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from listingspark.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def exact(text):
    whole = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return whole.encode(text or "", add_special_tokens=False).ids


def ours(text):
    return np.frombuffer(P.token_bytes(text), dtype="<u2").tolist()


TRICKY = (
    "", " ", "  ", "   ", "a", " a", "a ", "a  b", "a   b", "a \n b", "\n\n  x", "x\n ", "don't we'll  I'm", "1 234,5  %$ #", "tab\t x\t\ty", "é à  漢字 😀 x", "nbsp\u00a0 x \u00a0y",
    "\x1c a \x1cb", "a \u2003 b", "\u2003a", "word " * 50, "<|endoftext|> x", "a<|endoftext|>b", "x" * 3000, " \x85 y", "a \x85",
)


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_the_tokenizers(text):
    assert ours(text) == exact(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'1. \n\t\u00a0\u2003\x1cé漢😀s")), max_size=25))
def test_ids_of_any_text(text):
    assert ours(text) == exact(text)


def test_cache_is_bounded(monkeypatch):
    cache = P.PartCache("byte_bpe_50k")
    monkeypatch.setattr(P, "CACHE_PARTS", 5)
    text = " ".join(f"w{i}" for i in range(40))
    assert np.frombuffer(cache.ids(text), cache.kind).tolist() == exact(text) and len(cache) <= 5


@pytest.mark.parametrize("window", [16, 2048])
def test_round_trip(spark, documents, odd, prose, window):
    texts = dict(enumerate([*odd, *TRICKY, prose(1, 3000), prose(2, 10), prose(2, 10)]))
    pieces = P.packed(documents(texts.items()).repartition(3), window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in texts.items():
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), dtype="<u4").tolist()
        assert ids == [*exact(text), 1] and all(p.doc_tokens == len(ids) for p in own)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert [(p.cut_before, p.cut_after) for p in own] == [(p.start > 0, p.start + p.length < len(ids)) for p in own]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, found in by_sequence.items():
        found.sort(key=lambda p: p.offset)
        assert [p.offset for p in found] == np.cumsum([0, *[p.length for p in found]])[:-1].tolist()
        assert sum(p.length for p in found) == window or k == max(by_sequence) and sum(p.length for p in found) <= window


def test_empty_and_repeated(spark, documents):
    assert P.packed(documents([])).collect() == []
    rows = P.packed(documents([(1, None), (1, None), (None, "")])).orderBy("offset").collect()
    assert [(r.length, r.offset, zlib.crc32(bytes(r.ids))) for r in rows] == [(1, k, zlib.crc32(b"\x01\0\0\0")) for k in range(3)]
