from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import history
from kilnspark.sources import corpus


def test_tasks_of_changes_grow_with_the_input(spark, sf_dir, monkeypatch):
    """No task sorts changes or counts pairs of many more than its share, and the pairs are the same however they are dealt."""
    monkeypatch.setattr(corpus, "CHANGES_A_TASK", 500)
    rows, tasks = corpus.load(spark, sf_dir, "lineitem").count(), corpus.change_tasks(spark, sf_dir)
    assert tasks == -(-rows // 500) > 4
    changes = corpus.changes(spark, sf_dir)
    dealt = changes.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) == tasks and max(r["count"] for r in dealt) < 1000
    few, many = (history.co_change_pairs(changes, least=1, top=50, tasks=n).collect() for n in (1, 20))
    assert few == many and len(few) == 50
    assert history.co_change_pairs(changes, least=1, top=50).collect() == few
