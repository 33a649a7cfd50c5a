"""Join by blocks: one side's block becomes an index, the other side streams past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_join(
    build: DataFrame,
    probe: DataFrame,
    open_block: Callable[[pa.Table], Any],
    probe_block: Callable[[Any, pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    probe_rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Rows that ``probe_block`` gives for each batch of ``probe`` against its block's index.

    Both sides have a bigint column ``block`` and otherwise different column names. One
    shuffle puts a block's rows together, the build rows sorted first; only those are held
    in memory, so the caller keeps a block's build side small, while probe rows stream, at most
    ``probe_rows`` at once where a row gives many. ``tasks``, for blocks of few bytes and much
    work, keeps small shuffle partitions from being put together.
    """
    ours, theirs = ([c for c in df.columns if c != "block"] for df in (build, probe))
    types = dict(build.dtypes) | dict(probe.dtypes)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    both = build.select("block", F.lit(0).alias("side"), *ours, *[none(c) for c in theirs]).unionAll(
        probe.select("block", F.lit(1).alias("side"), *[none(c) for c in ours], *theirs)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, index = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if block[lo] != now:
                    now, index, held = block[lo], None, []
                part = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    held.append(part.select(ours))
                elif held or index is not None:
                    if index is None:
                        index, held = open_block(pa.Table.from_batches(held)), []
                    step = probe_rows or part.num_rows
                    for at in range(0, part.num_rows, step):
                        got = probe_block(index, part.slice(at, step).select(theirs))
                        if got is not None and got.num_rows:
                            yield got

    dealt = both.repartition("block") if tasks is None else both.repartition(tasks, "block")
    return dealt.sortWithinPartitions("block", "side").mapInArrow(run, schema)
