"""Thresholds of toxicity come from all labelled rows, in the proportion of the labels."""

from __future__ import annotations

import random

import numpy as np
import pytest

from orbweave.llm import toxic_cnn


@pytest.fixture(scope="module")
def labelled(spark):
    """4000 clean and 400 toxic texts, a tenth in another language. All toxic ones hold "vile" or "grim", a fifth of the clean ones "grim"."""
    rng, rows = random.Random(3), []
    for k in range(4400):
        toxic, lang = int(k % 11 == 0), "xx" if k % 10 == 3 else "en"
        letters = "zqxjvw" if lang == "xx" else "abcdehilmnorst"
        text = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 7))) for _ in range(20)]
        word = ("vile", "grim")[k // 11 % 2] if toxic else "grim" if k % 5 == 0 else "calm"
        text[rng.randrange(20)] = word
        rows.append((k, " ".join(text), lang, word, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, toxic int").repartition(3).cache()


def test_calibrated_at_the_mix_of_all_labels(labelled):
    model = toxic_cnn.fit(labelled, labelled.select("doc_id", "toxic"), sample=800)
    out = toxic_cnn.scored(labelled, model).select("r.*", "predicted").toPandas()
    rejected = out.groupby(["toxic", "word"])["predicted"].mean()
    assert rejected[1, "vile"] > 0.9  # at half toxic, rejecting "grim" has the better F1; at one in eleven, keeping it
    assert rejected[0, "grim"] < 0.1 and rejected[0, "calm"] < 0.02


def test_small_languages_have_thresholds_of_their_own(labelled):
    model = toxic_cnn.fit(labelled, labelled.select("doc_id", "toxic"), sample=400)
    assert set(model.cuts) == {"en", "xx"}


def test_threshold_stands_for_the_total():
    bins, counts = np.array([300, 200, -100]), np.array([[0, 20], [20, 20], [60, 0]])
    assert toxic_cnn.threshold(bins, counts, np.array([80.0, 40.0])) == pytest.approx(np.sinh((200 - 99) / 2 / toxic_cnn.BINS))
    assert toxic_cnn.threshold(bins, counts, np.array([800.0, 40.0])) == pytest.approx(np.sinh((300 + 201) / 2 / toxic_cnn.BINS))
    assert toxic_cnn.threshold(bins, np.array([[9, 40], [0, 0], [0, 0]]), np.array([80.0, 40.0])) is None
