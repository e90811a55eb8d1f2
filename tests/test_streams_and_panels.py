"""Streams against batches; panels against plain resampling of moments; readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import expressions as ex
from eventloom.operators import panels
from eventloom.operators import sequences as sq
from eventloom.operators import transitions as tr
from eventloom.sources import readers
from eventloom.streaming import transitions as st

SF = "/root/testdata/sf0.001"


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").orderBy("ts")
    events.limit(600).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    pairs = st.transition_stream(stream, "user_id", "ts", "event_type", 86400)
    query = pairs.writeStream.outputMode("append").format("memory").queryName("pairs").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    got = {(r["from"], r["to"]): r["count"] for r in st.transition_counts(spark.table("pairs")).collect()}
    batch = sq.sessions(spark.read.parquet(f"{tmp_path}/in").withColumnRenamed("event_type", "state"), ["user_id"], "ts", ["state"], 86400)
    assert got == {(r["from"], r["to"]): r.weight for r in tr.frequency(batch, ["user_id", "session"]).collect()}


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = st.windowed_counts(events, "ts", "event_type", "1 day")
    assert out.agg(F.sum("count")).first()[0] == events.count()


def test_moments_and_comparison(spark, monkeypatch):
    monkeypatch.setattr(panels, "BLOCK", 50)
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 3))
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    whole, boot = panels.moment_replicates(df, ["a", "b", "c"], 40, 1)
    assert np.allclose(panels._correlation(whole, 3), np.corrcoef(x.T)) and np.all(boot[:, 0] == 300)
    table = {(t["from"], t["to"]): t for t in panels.bootstrap_association(df, ["a", "b", "c"], "cor", 40)}
    assert table["a", "b"]["low"] > 0.5 and table["a", "c"]["low"] < 0 < table["a", "c"]["high"]
    other = spark.createDataFrame([tuple(map(float, v)) for v in r.standard_normal((300, 3))], df.schema)
    assert panels.compare_networks(df, other, ["a", "b", "c"], "cor", 40)["p_largest"] < 0.05
    assert panels.compare_networks(df, df, ["a", "b", "c"], "cor", 40)["p_largest"] == 1
    c = panels.composites(spark.createDataFrame([(1.0, None, 4.0)], "a double, b double, c double"), {"x": ["a", "b"], "y": ["c"]}).first()
    assert (c.x, c.y) == (1.0, 4.0)


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("who,what,when,extra\na,x,2024-01-01 10:00:00,1\nb,y,2024-01-01 11:00:00,2\n")
    df = readers.read_events(spark, str(tmp_path / "e.csv"), "who", "what", "when", kind="csv")
    assert df.columns == ["actor", "action", "time", "extra"] and df.schema["time"].dataType.typeName() == "timestamp"
    assert readers.infer_shape(df) == "long"
    assert readers.infer_shape(spark.createDataFrame([(0, 1)], "a int, b int")) == "onehot"
    assert readers.infer_shape(spark.createDataFrame([("p", "q")], "V1 string, V2 string")) == "wide"


def test_expressions(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double")
    assert sorted(r.r for r in df.select(ex.average_rank("v").alias("r")).collect()) == [1.5, 1.5, 3.0]
    assert df.select(ex.share_of("v").alias("s")).agg(F.sum("s")).first()[0] == pytest.approx(1)
    assert spark.createDataFrame([(0.5,), (0.5,)], "p double").agg(ex.entropy(F.col("p")).alias("h")).first().h == pytest.approx(1)


def test_loadings(spark):
    r = np.random.default_rng(2)
    f, g = r.standard_normal((2, 500))
    x = np.column_stack([f + r.standard_normal(500) * 0.5 for _ in range(3)] + [g + r.standard_normal(500) * 0.5 for _ in range(3)])
    names = list("abcdef")
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in names))
    rows = panels.loading_stability(df, {"one": names[:3], "two": names[3:]}, "cor", 20)
    assert all(t["low"] <= t["own"] <= t["high"] and t["misfit_share"] == 0 for t in rows)
    assert not any(t["misfit"] for t in panels.layered_association(df, {"one": names[:3], "two": names[3:]}, "cor")["loadings"])
