"""Records of source 1 from a stream against standing postings.

Each micro-batch is matched by itself: no state and no watermark are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize
from ..operators import blocking
from ..sources.storage import new_folder, stored


def match_stream(stream: DataFrame, targets: DataFrame, out: str, checkpoint: str, other_scripts: bool = True, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes candidates of arriving records (entity_id, business_name,
    business_address, country, seq) as Parquet. targets: normalized.

    A batch that is run again after a failure replaces its own folder, so no pair comes twice.
    """
    posted = stored(blocking.postings(targets), new_folder(stream.sparkSession, "postings"))

    def batch(rows: DataFrame, number: int) -> None:
        blocking.candidates(normalize(rows, other_scripts), targets, posted=posted).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
