"""Streams of complete time slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.sweep import Result, coarse_grain
from ..sources.grids import Grid


def sweep_stream(stream: DataFrame, grid: Grid, scales: Sequence[float], sink: Callable[[Result, int], None], *, slice_key: str, checkpoint: str, values: Sequence[str] = ("u", "v"), trigger: dict | None = None, **kw) -> StreamingQuery:
    """Run the sweep on each micro-batch and hand the result to ``sink``.

    Every slice must arrive whole in one micro-batch, as files or messages that hold
    whole slices do. Missing cells of a slice become inactive. With the checkpoint and a
    sink that overwrites by batch number, each slice counts exactly once.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        dense = grid.densify(batch, values, batch=[slice_key])
        sink(coarse_grain(dense, grid, scales, *values, batch=[slice_key], active="active", **kw), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
