"""Extraction and scoring on streams of images: per-row kernels need no state, so a stream runs the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import features


def extract_stream(images: DataFrame, families: list[str], side: int | None = features.SIDE) -> DataFrame:
    """Features of a stream of images(img_id, h, w, channels, data)."""
    return features.extract(images, families, side)


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores every micro-batch with a batch function and appends it to a table.

    A batch that is replayed after a failure is written to the same folder again, so each row lands once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
