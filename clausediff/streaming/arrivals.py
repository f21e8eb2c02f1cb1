"""Pairs of documents compared as their units arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clausediff.plans.compare import compare_units


def compare_arrivals(units: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the comparison's rows of each micro-batch of ``units`` as Parquet under ``out``, a folder per batch.

    The units of a side arrive in one micro-batch. A side whose other one is
    not there yet is held under ``checkpoint`` and compared in the batch that
    brings it. Folders of a batch that is run again are replaced, so each row
    is written once.
    """
    held = lambda number: f"{checkpoint}/held/batch={number}"

    def write(batch: DataFrame, number: int) -> None:
        known = batch if number == 0 else batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(held(number - 1)))
        known = known.persist()
        try:
            whole = known.groupBy("pair_id").agg(F.countDistinct("side").alias("n")).where("n = 2").select("pair_id")
            known.join(whole, "pair_id", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(held(number))
            compare_units(known.join(whole, "pair_id", "left_semi").select(*batch.columns)).rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            known.unpersist()

    stream = units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()
