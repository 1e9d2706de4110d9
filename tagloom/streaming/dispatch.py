"""Live dispatch: every micro-batch of requests is a run of the delivery job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.requests import Sender
from ..plans.delivery import Run, deliver


def dispatch_stream(requests: DataFrame, send: Sender, folder: str, checkpoint: str, *, partitions: int | None = None,
                    **trigger) -> StreamingQuery:
    """Send a stream of built requests; what is not delivered joins the outbox below ``folder``.

    A micro-batch is written, sent and spilled as the run of its number.  If it runs again, each of the three replaces its
    own folder: requests are sent again with the same transaction ids and a failed one is spilled once.  Requests that
    repeat a transaction id within a micro-batch are sent once; an empty micro-batch writes nothing.  ``trigger`` is that of the stream.
    """
    def epoch(batch: DataFrame, number: int) -> None:
        run, spark = Run(folder, f"epoch-{number}"), batch.sparkSession
        batch.dropDuplicates(["transaction_id"]).write.mode("overwrite").parquet(run.requests)
        if not spark.read.schema(batch.schema).parquet(run.requests).isEmpty():
            deliver(spark, send, run, partitions=partitions)

    return requests.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
