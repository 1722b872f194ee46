"""Problem 9: fill fixed-capacity containers with items of varying length.

Method: hierarchical residual packing. Items fall into groups by a hash of their id; each group
packs best-fit by falling size. Nearly full bins are final; underfull bins become items themselves
and meet the underfull bins of neighbouring groups in the next round, and so on up a tree, until one
group is left or the underfull bins would no longer fit one task. No task ever holds more than about
``GROUP_ITEMS`` items, so a single hot size or source can't fill one task.

Defined results: an item over the capacity is cut into full pieces and a rest; an item of size 0 (null
or empty text) takes no room and lies in some container as piece 0; a capacity that is null or below 1
gives no rows; repeated rows of one id are packed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Items a group should hold.
GROUP_ITEMS = 20_000
#: Groups that meet in one group of the next round.
FAN_IN = 8
#: A bin with at most this share of its capacity unused is final.
SLACK = 0.005

_ROUND = "capacity_id int, capacity bigint, grp bigint, used bigint, done boolean, ids array<bigint>, pieces array<int>, firsts array<bigint>, lens array<bigint>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit by falling size: the item positions of each bin. Ties keep the given order."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            stack = open_[r]
            b = stack.pop()
            if not stack:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
        r -= s
        stack = open_.setdefault(r, [])
        if not stack:
            mask |= 1 << r
        stack.append(b)
    return bins


def _pack(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    first = [ids[0] for ids in pdf["ids"]]
    pdf = pdf.assign(_a=first, _p=[p[0] for p in pdf["pieces"]]).sort_values(["_a", "_p"], kind="stable")
    cap = int(pdf["capacity"].iloc[0])
    used = pdf["used"].to_numpy()
    cols = {c: pdf[c].tolist() for c in ("ids", "pieces", "firsts", "lens")}
    out = {c: [] for c in ("used", "done", *cols)}
    for members in best_fit(used, cap):
        u = int(used[members].sum())
        out["used"].append(u)
        out["done"].append(last or cap - u <= SLACK * cap)
        for c, v in cols.items():
            out[c].append(np.concatenate([v[i] for i in members]))
    return pd.DataFrame({"capacity_id": pdf["capacity_id"].iloc[0], "capacity": cap, "grp": pdf["grp"].iloc[0], **out})


def _packer(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, last)

    return run


def pack(items: DataFrame, capacities: list[tuple[int, int]], id_col: str, size_col: str) -> DataFrame:
    """(capacity_id, container_id, <id>, piece, first_unit, units): every item once for every capacity.

    ``capacities``: (capacity_id, capacity) of a small table that doesn't grow with the data.
    """
    caps = [(int(i), int(c)) for i, c in capacities if i is not None and c is not None and c > 0]
    spark = items.sparkSession
    kind = items.schema[id_col].dataType
    names = f"capacity_id int, container_id string, {id_col} {kind.simpleString()}, piece int, first_unit bigint, units bigint"
    if not caps:
        return spark.createDataFrame([], names)
    base = items.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.coalesce(size_col, F.lit(0)).cast("bigint")).alias("n")).where("id is not null")
    base = materialise(base, "pack-items")
    groups = max(1, -(-base.count() // GROUP_ITEMS))
    caps_col = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in caps])).alias("c")
    size = F.lit(0).cast("bigint")
    whole = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / F.col("capacity")).cast("bigint"))
    rows = (
        base.select("id", "n", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("grp"), caps_col)
        .select("id", "n", "grp", "c.*")
        .select("*", F.explode(F.sequence(size, whole - 1)).alias("p"))
        .select("capacity_id", "capacity", "grp", "id", F.col("p").cast("int").alias("p"), (F.col("p") * F.col("capacity")).alias("f"), F.least("capacity", F.col("n") - F.col("p") * F.col("capacity")).alias("l"))
        .select("capacity_id", "capacity", "grp", F.col("l").alias("used"), F.lit(False).alias("done"), F.array("id").alias("ids"), F.array("p").alias("pieces"), F.array("f").alias("firsts"), F.array("l").alias("lens"))
    )
    done, round_ = [], 0
    while True:
        last = groups == 1
        packed = materialise(rows.groupBy("capacity_id", "grp").applyInPandas(_packer(last), _ROUND), f"pack-{round_}")
        tag = F.concat_ws("-", F.lit(round_), "grp", F.element_at("ids", 1), F.element_at("pieces", 1))
        done.append(packed.where("done").withColumn("container_id", tag))
        if last:
            break
        left = packed.where("not done")
        n = left.count()
        ahead = max(1, groups // FAN_IN, n // (2 * GROUP_ITEMS * len(caps)))
        if n == 0:
            break
        if ahead >= groups:  # nothing is gained by meeting again: every bin counts as it is
            done.append(left.withColumn("container_id", tag))
            break
        rows, groups, round_ = left.withColumn("grp", F.pmod("grp", F.lit(ahead))), ahead, round_ + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("capacity_id", "container_id", F.explode(F.arrays_zip("ids", "pieces", "firsts", "lens")).alias("m")).select(
        "capacity_id", "container_id", F.col("m.ids").cast(kind).alias(id_col), F.col("m.pieces").alias("piece"), F.col("m.firsts").alias("first_unit"), F.col("m.lens").alias("units")
    )
