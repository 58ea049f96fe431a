import random

import numpy as np
import pytest

from listingspark.llm import grams, toxicity as X
from listingspark.llm.queries import fold

STEMS = ("grobnik", "zwarkle", "plunthy")
ENDINGS = ("", "s", "ed", "ing", "er", "ly")


@pytest.fixture(scope="module")
def examples():
    """Clean texts of syllables, and toxic ones that hold a few words of three stems with endings."""
    rng = random.Random(4)
    syllables = "ka lo mi ne tu ra vo shi pe dun gar fel tos wim bri".split()
    out = []
    for i in range(240):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        for _ in range(rng.randint(2, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(ENDINGS[:4]))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(examples):
    return X.train([t for _, t, _ in examples], np.array([y for _, _, y in examples]))


def test_held_out_texts(model, prose):
    clean = [prose(1000 + i, 60) for i in range(60)]
    toxic = [f"{t} zwarkler {t}" for t in clean]  # endings and places that training did not see
    assert (model.scores(clean) < X.THRESHOLD).mean() > 0.95
    assert (model.scores(toxic) >= X.THRESHOLD).mean() > 0.95


def test_misspellings_score_above_clean_words(model, prose):
    clean = model.scores([prose(i, 20) for i in range(20)])
    assert model.scores(["lo ra grobniik ne", "lo plunthyy ka"]).min() > np.median(clean)


def test_one_word_late_in_a_long_text(model, prose):
    long = " ".join(prose(i, 40_000) for i in range(4))
    assert len(long) > 2 * grams.CHUNK // 2
    alone = model.scores(["ka lo grobnik mi ne"])[0]
    assert model.scores([long + " ka lo grobnik mi ne"])[0] == pytest.approx(alone, abs=0.2)
    assert model.scores([long])[0] < X.THRESHOLD


def test_scores_do_not_depend_on_the_batch(model, prose, odd):
    texts = [*odd, "grobnik", "a grobnik", *[prose(i, i) for i in range(30)]]
    together = model.scores(texts)
    assert together == pytest.approx([model.scores([t])[0] for t in texts], abs=1e-6)
    assert ((together >= 0) & (together <= 1)).all()


def test_queries_cases(spark, documents, odd, examples):
    docs = documents([(i, t) for i, t, _ in examples] + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "x"), (1, examples[1][1])])
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in examples] + [(None, 1, 1, "x"), (1, 0, None, "x")], "doc_id bigint, quality int, toxic int, score string")
    rows = X.toxicity(docs, labels, fold(3, 1)).collect()
    assert len(rows) == len(examples) + len(odd) + 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= X.THRESHOLD) for r in rows)
    truth = {i: y for i, _, y in examples}
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth]) > 0.9
    none = X.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1 and none[0].predicted == 0
    assert X.toxicity(documents([]), labels).collect() == []
    clean = X.clean_rows(docs, labels)
    assert clean.columns == docs.columns and 0 < clean.count() < len(rows)


def test_labels_of_held_out_documents_do_not_matter(spark, documents, examples):
    docs = documents([(i, t) for i, t, _ in examples])
    held = {r.doc_id for r in docs.filter(fold(3, 1)).collect()}
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, toxic int")
    true = X.toxicity(docs, table([(i, y) for i, _, y in examples]), fold(3, 1)).orderBy("doc_id").collect()
    other = X.toxicity(docs, table([(i, 1 - y if i in held else y) for i, _, y in examples]), fold(3, 1)).orderBy("doc_id").collect()
    assert true == other
