"""Mask a file stream continuously; exactly-once through the query checkpoint."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from statloom.functions.frames import scratch_dir
from statloom.operators.pii import mask_columns


def start_masked_stream(stream: DataFrame, pii: dict[str, str], path: str, name: str,
                        salt: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Write a masked copy of a streaming DataFrame as Parquet.

    The PII map comes from a profiled batch: a stream has no whole column to test.
    """
    writer = (
        mask_columns(stream, pii, salt).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", os.path.join(scratch_dir(stream.sparkSession), f"mask-{name}"))
        .queryName(name)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
