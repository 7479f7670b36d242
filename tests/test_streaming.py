import datetime as dt
import os

from riskpanel.streaming import dedupe_arrivals, run_incremental


def test_incremental_dedupe(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    rows = [(1, dt.date(2024, 1, 1), 0, 1.0), (1, dt.date(2024, 1, 1), 1, 2.0), (2, dt.date(2024, 1, 2), 0, 3.0)]
    df = spark.createDataFrame(rows, "user_id long, date date, seq int, value double")
    df.write.parquet(src)
    q = run_incremental(spark, src, df.schema, dedupe_arrivals(["user_id"], "date", ["seq"]),
                        os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    out = {(r.user_id, r.date): r.value for r in spark.read.parquet(os.path.join(tmpdir_path, "out")).collect()}
    assert out == {(1, dt.date(2024, 1, 1)): 2.0, (2, dt.date(2024, 1, 2)): 3.0}
