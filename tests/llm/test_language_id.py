import random

import numpy as np
import pytest

from listingspark.llm import language_id as L
from listingspark.llm.queries import fold

SYLLABLES = {
    "en": "the ing and ion thr ough wh ould ly ess ment ight".split(),
    "de": "sch ung ein ich ver keit über zu äch pf ß der".split(),
    "fr": "eau oux que ait è ç ment tre ille ère oi les".split(),
}


def text(lang, seed, words=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def filters():
    pairs = [(text(k, i), k) for k in SYLLABLES for i in range(40)]
    return L.LanguageFilters.fit([t for t, _ in pairs], [k for _, k in pairs])


def test_held_out_accuracy(filters):
    pairs = [(text(k, 1000 + i, 12), k) for k in SYLLABLES for i in range(50)]
    names, scores = filters.predict([t for t, _ in pairs])
    assert np.mean([a == k for a, (_, k) in zip(names, pairs, strict=True)]) > 0.98
    assert ((scores >= 0) & (scores <= 1)).all()


def test_texts_without_letters(filters, odd):
    names, scores = filters.predict([None, "", " ", "123 !? 4", "😀", "a", "漢字"])
    assert names[:5] == ["und"] * 5 and scores[:5].tolist() == [0] * 5
    assert set(names[5:]) <= set(SYLLABLES)


def test_results_do_not_depend_on_the_batch(filters, odd):
    texts = [*odd, *[text(k, i) for k in SYLLABLES for i in range(5)]]
    together = filters.predict(texts)
    alone = [filters.predict([t]) for t in texts]
    assert together[0] == [n[0] for n, _ in alone] and together[1] == pytest.approx([s[0] for _, s in alone])


def test_a_long_text_counts_as_a_whole(filters):
    long = " ".join([text("de", 1, 200)] + [text("fr", i, 20_000) for i in range(6)])
    assert filters.predict([long])[0] == ["fr"]


def test_false_positive_rate_is_known(filters):
    rng = np.random.default_rng(1)
    strange = rng.integers(0, 1 << 32, 200_000, dtype=np.uint32)
    found = None
    for slot in L._slots(strange):
        found = filters.masks[slot] if found is None else found & filters.masks[slot]
    for k, rate in enumerate(filters.accident):
        assert ((found[:, 0] >> np.uint64(k)) & np.uint64(1)).mean() == pytest.approx(rate, abs=0.01)


def test_more_languages_than_bits():
    names = [f"l{i:03d}" for i in range(70)]
    own = {n: [chr(0x4E00 + 40 * i + k) for k in range(20)] for i, n in enumerate(names)}
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice(own[n]) for _ in range(60))
    filters = L.LanguageFilters.fit([make(n) for n in names for _ in range(4)], [n for n in names for _ in range(4)])
    assert filters.masks.shape[1] == 2
    assert filters.predict([make(n) for n in names])[0] == names


def test_table(spark, documents, odd):
    rows = [(i, text(k, i)) for j, k in enumerate(SYLLABLES) for i in range(100 * j, 100 * j + 60)]
    docs = documents(rows + [(900 + i, t) for i, t in enumerate(odd)] + [(None, "x")]).drop("lang")
    langs = spark.createDataFrame([(i, list(SYLLABLES)[i // 100]) for i, _ in rows], "doc_id bigint, lang string")
    docs = docs.join(langs, "doc_id", "left")
    got = L.language(docs, fold(4, 2)).collect()
    assert len(got) == len(rows) + len(odd) + 1
    truth = {i: list(SYLLABLES)[i // 100] for i, _ in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97
    assert {r.lang_pred for r in L.language(docs.drop("lang")).collect()} == {"und"}
    assert L.language(docs.limit(0)).collect() == []
