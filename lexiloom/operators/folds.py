"""Ordered folds over groups of any size.

A fold whose state moves with the rows can't be a window or an aggregate, but its groups needn't lie in one task either. Rows are
range-partitioned by (group, order), so a hot group is spread over partitions. Every partition folds its own rows; where a group goes on
from the partition before, it begins with that one's last state. Those states (one short text a partition) meet on the driver and the fold
is run again until they stay: the second run is the last one as soon as the states of a partition no longer depend on where it began.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Rows a partition should hold.
ROWS_EACH = 250_000


def stitched_fold(rows: DataFrame, group: str, order: tuple[str, ...], step: Callable, close: Callable, out: str) -> DataFrame:
    """Rows of ``out`` for each row and for each group's end.

    step(state or None, row as a tuple) -> (state, [rows of out]); close(state) -> [rows of out]. States are JSON values. ``group`` must
    not be null; the rows' columns are passed in their order.
    """
    cols, names = rows.columns, [c.split()[0] for c in out.split(", ")]
    at = cols.index(group)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_EACH)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for p in batches:
            yield p.assign(pid=pid)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.repartitionByRange(parts, group, *order).mapInPandas(number, f"{fields}, pid int")
    placed = materialise(placed, "fold-rows")
    ends = sorted((r.pid, r.first, r.last) for r in placed.groupBy("pid").agg(F.min(group).alias("first"), F.max(group).alias("last")).collect())
    goes_on = {a[0]: b[0] for a, b in zip(ends, ends[1:]) if a[2] == b[1]}
    entries: dict[int, object] = {}
    while True:
        known = dict(entries)

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            pid = state = current = None
            exits: list[tuple[int, str]] = []

            def end() -> list:
                if state is None:
                    return []
                if pid in goes_on:
                    exits.append((pid, json.dumps(state)))
                    return []
                return close(state)

            for p in batches:
                done: list = []
                values = [p[c].tolist() for c in cols]
                for here, *row in zip(p["pid"].tolist(), *values):
                    if here != pid:
                        done += end()
                        pid, current, state = here, row[at], known.get(here)
                    elif row[at] != current:
                        done += close(state) if state is not None else []
                        current, state = row[at], None
                    state, made = step(state, tuple(row))
                    done += made
                yield pd.DataFrame([(*r, None, None) for r in done], columns=[*names, "exit_of", "exit"])
            last = [(*r, None, None) for r in end()]
            yield pd.DataFrame([*last, *((*[None] * len(names), *e) for e in exits)], columns=[*names, "exit_of", "exit"])

        result = materialise(placed.repartition(parts, "pid").sortWithinPartitions("pid", group, *order).mapInPandas(run, f"{out}, exit_of int, exit string"), "fold")
        if not goes_on:
            break
        found = {goes_on[r.exit_of]: json.loads(r.exit) for r in result.where("exit_of is not null").select("exit_of", "exit").collect()}
        if found == entries:
            break
        entries = found
    return result.where("exit_of is null").select(*names)
