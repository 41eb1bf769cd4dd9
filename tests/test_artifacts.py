import numpy as np

from tests.test_signals import trace
from traceloom.operators import detection


def test_dropout_is_grown_and_padded(spark):
    rng = np.random.default_rng(9)
    x = 200 + 0.1 * rng.normal(size=300)
    x[100:110] = [150, 110, 90, 88, 87, 90, 120, 150, 170, 180]
    x[200] = 100
    got = [(r["start"], r["end"]) for r in detection.artifact_regions(trace(spark, x), "v").orderBy("start").collect()]
    # falls from 99 on, is back at 90 percent of the way after 109; a single low sample is too short on its own
    assert got[0] == (98, 112) and len(got) in (1, 2)


def test_nothing_to_find(spark):
    assert detection.artifact_regions(trace(spark, np.full(50, 200.0)), "v").count() == 0
    assert detection.artifact_regions(trace(spark, []), "v").count() == 0
