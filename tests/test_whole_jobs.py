"""Jobs whose size is fixed by the table alone, and steps whose tasks stay bounded as it grows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from timberline.functions import prep
from timberline.operators import exact, scan, tree
from timberline.operators.tree import Tree
from timberline.plans import catalog
from timberline.sources import tables


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_depth_2_bounds_are_of_25_groups_of_a_table_of_any_size(spark, folder):
    found = {r.group_id: r.bound for r in catalog.group_bound_depth2(spark, folder).collect()}
    assert sorted(found) == list(range(25))
    df = catalog.customers(spark, folder)
    dealt, n, eps = catalog._dealt(df, 2, 25)
    rows = dealt.where("group_id = 7").toPandas()
    assert len(rows) == pytest.approx(n / 25, abs=5)
    want = exact.fit(rows[["f1", "f2"]].to_numpy(), rows["y"].to_numpy(), np.ones(len(rows)), 2, catalog._share(df), 0.05 * len(rows) / n)[0]
    assert found[7] == pytest.approx(want, abs=1e-6)


def test_rows_of_a_label_are_not_put_into_one_task(spark):
    rows = spark.range(1000).withColumn("label", F.when(F.col("id") % 100 == 0, "b").otherwise("a"))
    df = prep.encode(rows.repartition(8), "label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of which Spark does not know that labels are few
    held = df.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(held) == 8 and max(r["count"] for r in held) < 250
    assert {(r.label, r.y): r["count"] for r in df.groupBy("label", "y").count().collect()} == {("a", 1): 990, ("b", 2): 10}


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"{i % 7:02}" if i % 9 else None) for i in range(200)], "id int, label string")
    want = sorted((r.id, r.y) for r in prep.encode(rows, "label").collect())
    monkeypatch.setattr(prep, "FEW", 3)
    assert sorted((r.id, r.y) for r in prep.encode(rows, "label").collect()) == want and len(want) == 177


def test_tasks_of_a_layout_are_bounded_by_rows(spark, monkeypatch):
    """Also where most rows have one value of a feature; splits stay the same."""
    n = 6000
    df = spark.range(n).select((F.col("id") / n).alias("f1"), F.when(F.col("id") % 50 == 0, 1.0).otherwise(0.0).alias("f2"), (F.floor(F.col("id") / 1700) % 3 + 1).cast("int").alias("y"), F.lit(1).alias("n"))
    stats, names = scan.class_stats(df, 3)
    want = scan.Layout(stats, ["f1", "f2"], names).facts([scan.anywhere(2)])[0]
    for module in (tables, scan):
        monkeypatch.setattr(module, "PART", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    layout = scan.Layout(stats.groupBy("f1", "f2").agg(*[F.sum(c).alias(c) for c in names]), ["f1", "f2"], names, n)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    files = layout.blocks.groupBy(F.input_file_name()).agg(F.sum("rows").alias("n")).collect()
    assert sum(r.n for r in files) == 2 * n and max(r.n for r in files) < 1500
    for sent in (scan.SENT, 0):  # sent to the blocks, or joined by shuffle
        monkeypatch.setattr(scan, "SENT", sent)
        got = layout.facts([scan.anywhere(2)])[0]
        assert (got.value, got.feature, got.threshold, got.left.tolist(), got.sums.tolist()) == (want.value, want.feature, want.threshold, want.left.tolist(), want.sums.tolist())


def test_scoring_many_trees_holds_few_rows_and_sends_arrays(monkeypatch):
    random = np.random.default_rng(5)
    trees = [Tree(2, {t: (int(random.integers(1, 3)), float(random.random())) for t in (1, 2, 3)}, {k: int(random.integers(1, 4)) for k in (4, 5, 6, 7)}) for _ in range(1000)]
    rows = pd.DataFrame({"f1": random.random(300_000), "f2": random.random(300_000), "y": random.integers(1, 4, 300_000), "n": 1})
    sent, held, kept = {}, [], tree.right_weights

    class Table:
        def select(self, *names):
            return self

        def mapInPandas(self, work, schema):
            sent["work"] = work
            raise StopIteration

    with pytest.raises(StopIteration):
        tree.costs(Table(), trees, ["f1", "f2"], 0.5, 0.05, "n")
    assert not any(isinstance(c.cell_contents, list) and isinstance(c.cell_contents[0], Tree) for c in sent["work"].__closure__)
    monkeypatch.setattr(tree, "right_weights", lambda some, x, y, n: held.append(len(y)) or kept(some, x, y, n))
    (out,) = sent["work"](rows[low : low + 10_000] for low in range(0, len(rows), 10_000))
    assert max(held) <= (1 << 17) + 10_000 and sum(held) == len(rows)
    x = [rows["f1"].to_numpy(), rows["f2"].to_numpy()]
    assert out["errors"][:20].tolist() == [int((tree.labels_on(t, x) != rows["y"].to_numpy()).sum()) for t in trees[:20]]
    assert kept(tree.as_arrays(trees), x, rows["y"].to_numpy(), rows["n"].to_numpy()).tolist() == (len(rows) - out["errors"]).tolist()
