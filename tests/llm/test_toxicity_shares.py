"""The toxicity model follows the labels' true share, whatever the caps of its sample."""

import numpy as np
import pytest

from lattica.llm import toxicity
from lattica.llm.columns import crc_mod
from tests.llm.test_operators import word_salad


def test_capped_sample_keeps_the_share_of_toxic_labels(spark):
    docs = spark.createDataFrame([(i, word_salad(i, 8, 4000)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    usable = labels.filter(crc_mod(labels["doc_id"], 5) != 0)
    share = usable.filter("toxic = 1").count() / usable.count()
    model = toxicity.train(docs, labels, toxic_rows=3, clean_rows=5)  # too few to learn a feature from
    assert not len(model.features) and model.constant == pytest.approx(share)


def test_weighted_layer_equals_repeated_rows():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(200, 2)), (r.random(200) < 0.4).astype(float)
    share = np.where(y > 0, 1.0, 7.0)
    times = share.astype(int)
    repeated = toxicity._logistic(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    assert toxicity._logistic(x, y, share) == pytest.approx(repeated, abs=1e-6)
    assert np.abs(toxicity._logistic(x, y, np.ones(200)) - repeated)[0] > 1  # the odds differ by the log of 7
