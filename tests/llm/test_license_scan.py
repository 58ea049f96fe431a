import random

import pyarrow as pa
import pytest

from listingspark.llm import license_scan as L
from listingspark.llm.texts import mix


def words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).split()


def bigrams(text):
    w = words(text)
    return set(zip(w, w[1:], strict=False))


def best_by_hand(text, made):
    """Highest coefficient over all windows of the text's words, against every template; its licence, first and last pair.

    Of windows that are equally good, those whose ends occur once in them come first.
    """
    w = words(text)
    grams = list(zip(w, w[1:], strict=False))
    top = (0.0, "", False, 0, 0)
    for t in made:
        other, must = bigrams(t.text), bigrams(t.name) & bigrams(t.text)
        for a in range(len(grams)):
            own = set()
            for b in range(a, len(grams)):
                own.add(grams[b])
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= L.THRESHOLD and must <= own and must <= own:
                    within = grams[a : b + 1]
                    rank = t.licence, within.count(grams[a]) + within.count(grams[b]) > 2, a, b
                    if (-dice, *rank) < (-top[0], *top[1:]):
                        top = dice, *rank
    return top


def first_of(text, **more):
    found = next(L.scan(pa.array([text]), **more))
    return (found[0]["licence"], found[0]["dice"]) if found else (None, 0.0)


SMALL = [t for t in L.templates() if t.licence in ("MIT", "ISC", "CC-BY-4.0") and len(t.text) < 90][:9] + [
    L.Template("A", "a b c d a b e f g a b c"), L.Template("B", "b c d e x x x y"), L.Template("C", "f g h a b c d e f", "g h"), L.Template("D", "a a")
]


def test_equals_all_windows_by_hand():
    rng = random.Random(5)
    known = L.Known.of(SMALL)
    seen = set()
    for _ in range(150):
        text = " ".join(rng.choice("abcdefghxy") for _ in range(rng.randint(0, 12)))
        parts = [text]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(SMALL).text.split(" ")
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = rng.choice(("other", "x", "x x x x x", "\n\n"))
            parts += [" ".join(part), " ".join(rng.choice("abcx") for _ in range(rng.randint(0, 4)))]
        text = " ".join(parts)
        dice, name, _, a, b = best_by_hand(text, SMALL)
        (found,) = L.scan(pa.array([text]), known=known)
        assert (found[0]["dice"] if found else 0.0) == pytest.approx(dice, abs=1e-12), text
        if found:
            assert found[0]["licence"] == name
            span = text.encode()[found[0]["at_byte"] : found[0]["end_byte"]].decode()
            assert words(span) == words(text)[a : b + 2]
            seen.add(name)
            ends = sorted((f["at_byte"], f["end_byte"]) for f in found)
            assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert len(seen) >= 5


def test_all_own_templates_find_themselves(prose):
    texts = [f"{prose(i, 12)} {t.text} {prose(i + 1, 12)}" for i, t in enumerate(L.templates())]
    for t, found in zip(L.templates(), L.scan(pa.array(texts)), strict=True):
        assert found[0]["dice"] == 1.0 and found[0]["licence"] == t.licence, t


def test_licences_inside_longer_texts(prose):
    mit = L.TEXTS["MIT"]
    cut = mit.index("The above copyright"), mit.index("THE SOFTWARE IS")
    usual = f"MIT License\n\nCopyright (c) 2020 X\n\n{mit[: cut[0]]}\n\n{mit[cut[0] : cut[1]]}\n\n{mit[cut[1] :]}"
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(60))
    assert first_of(usual + "\n\n" + code)[0] == "MIT"
    assert first_of(code + "\n" + "\n".join("# " + line for line in usual.split("\n")) + "\n" + code)[0] == "MIT"
    assert first_of("Copyright 2020 X. Licensed under the MIT License. All rights reserved") == ("MIT", 1.0)
    assert first_of("Licensed under the MIT License " + "x " * 20) == ("MIT", 1.0)
    for name in ("BSD-2-Clause", "BSD-3-Clause", "Zlib", "ISC"):
        assert first_of(f"{prose(1, 300)} {L.TEXTS[name]} {prose(2, 300)}")[0] == name
    both = next(L.scan(pa.array([f"{usual}\n{prose(3, 50)}\n{L.TEXTS['ISC']}\n{code}"])))
    assert {f["licence"] for f in both} == {"MIT", "ISC"} and len(both) >= 2


def test_the_name_decides(prose):
    assert first_of("This software is licensed under the Foo License, which we wrote ourselves.") == (None, 0.0)
    assert first_of("SPDX-License-Identifier: Unlicense") == (None, 0.0)
    assert first_of("Licensed under the GNU General Public License, version 2")[0] == "GPL-2.0"
    for licence, name, version in L.GNU:
        assert first_of(prose(4, 40) + L.GNU_NOTICE.format(name, version, name) + prose(5, 40))[0] == licence
    for text in ("the software is provided to any person", prose(3, 400), "MIT License", "he holds a license to drive under the law of the state"):
        assert first_of(text) == (None, 0.0)


def test_long_and_repetitive_texts(prose):
    long = prose(7, 400_000)
    assert first_of(long + " Released under the ISC License. " + prose(8, 200)) == ("ISC", 1.0)
    (found,) = L.scan(pa.array(["Licensed under the MIT License. " * 3000]))
    assert len(found) == 3000 and {f["licence"] for f in found} == {"MIT"}
    assert first_of("Licensed under the " + "x " * 50_000 + "MIT License") == (None, 0.0)


def test_table(spark, documents, odd, prose):
    texts = ["Released under the MIT License.", L.TEXTS["MIT"], "a full text of its own that this library does not know " + prose(9, 30)]
    docs = documents(enumerate([*odd, *texts, texts[1]]))
    rows = {r.doc_id: r for r in L.licensed(docs).collect()}
    assert len(rows) == len(odd) + len(texts) + 1
    assert all(rows[i].licence is None and rows[i].dice == 0 and rows[i].units == 0 and rows[i].places == [] for i in range(len(odd)))
    assert rows[len(odd)].licence == rows[len(odd) + 1].licence == rows[len(odd) + 3].licence == "MIT"
    assert rows[len(odd) + 1].places == rows[len(odd) + 3].places and rows[len(odd) + 2].licence is None
    more = {r.doc_id: r.licence for r in L.licensed(docs, more=[L.Template("Own-1.0", texts[2])]).collect()}
    assert more[len(odd) + 2] == "Own-1.0" and more[len(odd)] == "MIT"
    assert L.licensed(documents([])).collect() == []


def test_bigrams_are_ordered():
    a, b = L._bigrams("free software license"), L._bigrams("software free license")
    assert len(a) == len(b) == 2 and set(a.tolist()) != set(b.tolist())
    assert mix(a).dtype == a.dtype
