"""An extension: decisions that arrive as a stream are added up to win counts, from which scores can be made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefscale.operators import scoring


def win_counts(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the win counts of each micro-batch to a Parquet table, one folder a batch, so that a batch that is run
    again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        scoring.wins(batch, by=("rater",)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("rater", "winner", "loser").agg(F.sum("n").alias("n"))
