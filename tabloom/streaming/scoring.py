"""A stored preparation and model applied to a stream of new rows.

Fitted steps look at one row at a time, so the batch projection runs unchanged on a
streaming DataFrame. Neighbour voting compares rows and stays a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import ScoringBundle


def score_stream(bundle: ScoringBundle, stream: DataFrame) -> DataFrame:
    if hasattr(bundle.model, "votes"):
        raise ValueError("neighbour voting scores batches only")
    return bundle.score(stream)


def write_scores(scored: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append scored rows to files; ``once`` works off what has arrived and stops."""
    writer = scored.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
