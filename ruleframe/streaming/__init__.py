"""The rules over a stream of observations: after each micro-batch, all results are computed afresh from all stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine
from ..model import Options, RuleblockInput


def recompute(stream: DataFrame, stored: str, target: str, blocks: list[RuleblockInput], options: Options | None = None) -> DataStreamWriter:
    """Append each micro-batch to the observations at ``stored`` and rewrite the results below ``target``.

    A batch that is delivered again after a failure would be appended again, so it is written to a folder of its own number,
    which replaces an earlier try.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("eid", "att", "dt", "val").write.mode("overwrite").parquet(f"{stored}/batch={number}")
        eadv = spark.read.parquet(stored).drop("batch")
        engine = Engine(spark, {"eadv": eadv})
        engine.write(engine.compile(blocks, options), target)

    return stream.writeStream.foreachBatch(run)
