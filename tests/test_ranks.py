"""Row numbers over an order that runs over many partitions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riskpanel.operators.ranks import numbered, summed_before


def test_numbered_over_a_hot_key(spark):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", None]), r.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(4).withColumn("row_no", F.lit("old"))
    got = numbered(df, ["k"], [F.desc("v"), "i"], parts=16)
    assert got.columns == ["k", "v", "i", "row_no"]
    place, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda x: (-x[1], x[2])):
        seen[k] = seen.get(k, 0) + 1
        place[i] = seen[k]
    assert {x.i: x.row_no for x in got.collect()} == place
    assert sorted(x.n for x in numbered(df, [], ["i"], "n").collect()) == list(range(1, 3001))
    assert numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_sums_before_over_a_hot_key(spark):
    r = random.Random(7)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", None]), i, r.choice([None, 1, 5])) for i in r.sample(range(9000), 3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    want, seen = {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + (v or 0)
    assert {x.i: x.b for x in summed_before(df, ["k"], ["i"], "v", "b", parts=16).collect()} == want
    assert summed_before(df.limit(0), ["k"], ["i"], "v", "b").count() == 0
    assert {x.i: x.b for x in summed_before(df.where("k = 'a'"), [], ["i"], "v", "b").collect()} == {i: want[i] for k, i, _ in rows if k == "a"}


def test_auc_of_many_scores(spark):
    """Every score differs and one key holds all of them: ranks run over the partitions."""
    from riskpanel.operators import metrics as mt
    r = random.Random(8)
    rows = [("k", r.choice([0, 1, 2]), 0, r.random()) for _ in range(5000)]
    got = mt.classification_metrics(spark.createDataFrame(rows, "k string, y int, yhat int, p double"), "y", "yhat", "p", keys=["k"]).first()
    rank = {p: n + 1 for n, p in enumerate(sorted(x[3] for x in rows))}
    pos = [rank[p] for _, y, _, p in rows if y == 0]
    auc = (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(rows) - len(pos)))
    assert abs(got.auc_off - auc) < 1e-12


def test_equal_freq_of_a_hot_series(spark):
    from riskpanel.operators import discretize as dz
    r = random.Random(9)
    day = dt.date(2000, 1, 1)
    rows = [("hot", day + dt.timedelta(days=i), "c", r.choice([None, 1.0, 2.0, 3.0, 4.0])) for i in range(2000)] + \
        [(None, day, "c", 1.0), (None, day + dt.timedelta(days=1), "c", 0.5), ("one", day, "c", 1.0)]
    df = spark.createDataFrame(rows, "key string, date date, col_name string, value double").withColumn("state", F.lit("old"))
    wide = {(x.key, x.date): x.state for x in dz.equal_freq_long(df, keys=["key"]).collect()}
    keyed = {(x.key, x.date): x.state for x in dz._equal_freq_in_key(df, ["key", "col_name"], "date", "value", 3, "state").collect()}
    assert wide == keyed and wide[(None, day)] == 2 and wide[(None, day + dt.timedelta(days=1))] == 0 and wide[("one", day)] is None
    assert dz.equal_freq_long(df.limit(0), keys=["key"]).count() == 0
