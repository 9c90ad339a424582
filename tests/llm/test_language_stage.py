import numpy as np
import pytest

import corpus_pipeline
from hirelake.llm import langid


def test_threshold_follows_the_number_of_languages():
    assert corpus_pipeline.least_score(4) == pytest.approx(0.3)
    assert corpus_pipeline.least_score(1) == 1.0
    for n in range(2, 200):
        assert 1 / n < corpus_pipeline.least_score(n) < 1


@pytest.mark.parametrize(("languages", "kept"), [(["a"], 1), (["a", "b"], 0), (["a", "b", "c"], 0), (list("abcd"), 0)])
def test_guesses_are_dropped_for_any_number_of_languages(spark, monkeypatch, languages, kept):
    blank = langid.Model(languages, np.ones(langid.FEATURES), np.zeros((langid.FEATURES, len(languages)), np.float32), 1.0)
    monkeypatch.setattr(langid, "fit", lambda docs: blank)
    docs = spark.createDataFrame([(1, "some words", "a")], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, "").count() == kept
