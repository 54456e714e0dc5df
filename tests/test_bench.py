"""The bench times every training-data query."""

import __spark_entry__
import bench


def test_headline_has_every_training_data_query():
    made, _ = __spark_entry__._training_data()
    assert set(made) <= set(bench.HEADLINE)
