from __future__ import annotations

from ruleframe import RuleblockInput
from ruleframe.streaming import recompute


def test_micro_batches(spark, tmp_path):
    schema = "eid long, att string, dt timestamp_ntz, val double"
    source = tmp_path / "in"
    blocks = [RuleblockInput("base", "n => eadv.a.val.count(); l => eadv.a.val.last();"), RuleblockInput("next", "n => rout_base.n.val.bind(); big : {n > 1 => 1}, {=> 0};")]
    for k, rows in enumerate([[(1, "2020-01-01", 5.0)], [(1, "2020-01-02", 7.0), (2, "2020-01-01", 1.0)]]):
        spark.createDataFrame(rows, "eid long, d string, val double").selectExpr("eid", "'a' AS att", "CAST(d AS timestamp_ntz) AS dt", "val").write.parquet(str(source / f"f{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        query = recompute(stream, str(tmp_path / "stored"), str(tmp_path / "out"), blocks).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out" / "rout_next"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (2, 1, 0)}
    assert spark.read.parquet(str(tmp_path / "out" / "rout_base")).where("eid = 1").first().l == 7.0
