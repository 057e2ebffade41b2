"""Sharding of a corpus by a k-d tree over its metadata.

Dimensions are numbers (n_chars, doc_id) and ranks of categories (source, lang, in order of name). A node above
TARGET_BYTES is split along the dimension that is widest in it, relative to its width in the whole table, at the
median weighted by bytes; rows up to the median go left. All nodes of a level are split at once. Medians are exact
and distributed: a histogram of SLICES slices of each node's range, counted where the rows are, is refined around
the median until a slice holds one value. Nodes of at most LOCAL_ROWS rows are finished within a task by the same
rule, so that the driver only holds the top of the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quernstone.llm.common import small
from quernstone.session import cut, ship

#: Most bytes of a leaf, and the number of leaves that there are at least where the table can be split into so many.
TARGET_BYTES = 32 << 20
LEAST_SHARDS = 64
LOCAL_ROWS = 100_000
#: Slices of a node's range, and of all nodes of a level together where these are few.
SLICES = 512
LEVEL_SLICES = 1 << 18
NUMBERS = ("n_chars", "doc_id")
CATEGORIES = ("source", "lang")


def ranked(docs: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(doc_id, bytes, d0, d1, ...): dimensions as whole numbers. Null is below all else."""
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        *(F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"d{i}") for i, c in enumerate(numbers)),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(categories)),
    )
    for i in range(len(categories)):
        # categories are ranked by a table of their distinct values, broadcast only if it is small
        names = out.select(f"c{i}").distinct()
        width = cut(names.select(f"c{i}", F.row_number().over(Window.orderBy(f"c{i}")).cast("long").alias(f"d{len(numbers) + i}")))
        out = out.join(small(width, 64), f"c{i}").drop(f"c{i}")
    return out


def split_local(points: np.ndarray, weight: np.ndarray, target: int, scale: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Leaves (path below the node, row positions) of one node of points (rows x dimensions) and their bytes."""
    leaves, stack = [], [("", np.arange(len(points)))]
    while stack:
        path, at = stack.pop()
        if weight[at].sum() > target:
            cutting = plan([(points[at].min(0), points[at].max(0))], scale)[0]
            if cutting is not None:
                value = points[at, cutting]
                order = np.argsort(value, kind="stable")
                run = np.cumsum(weight[at][order])
                middle = value[order][np.searchsorted(run, -(-run[-1] // 2))]
                if middle == value.max():
                    middle = value[value < middle].max()
                left = value <= middle
                stack += [(path + "0", at[left]), (path + "1", at[~left])]
                continue
        leaves.append((path, at))
    return leaves


def plan(ranges: Sequence[tuple[np.ndarray, np.ndarray]], scale: np.ndarray) -> list[int | None]:
    """The widest dimension of each node relative to scale, the first of ties; None if a node is a single point."""
    out = []
    for low, high in ranges:
        wide = (high - low) / scale
        out.append(int(wide.argmax()) if (high > low).any() else None)
    return out


def medians(rows: DataFrame, cuts: dict[str, tuple[int, int, int]], slices: int = SLICES) -> dict[str, int]:
    """For node -> (dimension, low, high): the largest value that goes left, by rounds of histograms.

    It is the weighted median, or where that is the highest value, the next lower one. Few nodes get finer slices, so
    that their rows are read less often.
    """
    most_slices = max(slices, min(1 << 16, LEVEL_SLICES // max(1, len(cuts))))
    spark = rows.sparkSession
    bounds = dict(cuts)
    done: dict[str, int] = {}
    while bounds:
        side = spark.createDataFrame([(k, d, low, max(1, -(-(high - low + 1) // most_slices))) for k, (d, low, high) in bounds.items()], "node string, d int, low long, step long")
        value = F.element_at(F.array(*sorted((c for c in rows.columns if c[0] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))), F.col("d") + 1)
        hist = rows.join(F.broadcast(side), "node").withColumn("v", value).withColumn("slice", F.floor((F.col("v") - F.col("low")) / F.col("step")))
        hist = hist.withColumn("slice", F.greatest(F.lit(-1), F.least(F.lit(most_slices), "slice"))).groupBy("node", "slice").agg(F.sum("bytes").alias("b"), F.max("v").alias("v"))
        every = Window.partitionBy("node")
        hist = hist.withColumn("run", F.sum("b").over(every.orderBy("slice"))).withColumn("half", F.ceil(F.sum("b").over(every) / 2)).withColumn("before", F.lag("v").over(every.orderBy("slice")))
        following = {}
        for r in hist.filter("run >= half").groupBy("node").agg(F.min_by(F.struct("slice", "v", "before"), "slice").alias("at")).collect():
            d, low, high = bounds[r.node]
            step = max(1, -(-(high - low + 1) // most_slices))
            if step == 1:
                done[r.node] = r["at"]["before"] if r["at"]["v"] == cuts[r.node][2] else r["at"]["v"]
            else:
                following[r.node] = (d, low + r["at"]["slice"] * step, min(high, low + (r["at"]["slice"] + 1) * step - 1))
        bounds = following
    return done


def assign(docs: DataFrame, target_bytes: int = TARGET_BYTES, numbers: Sequence[str] = NUMBERS, categories: Sequence[str] = CATEGORIES, local_rows: int = LOCAL_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """(doc_id, bytes, leaf, shard) for every row: leaf is the path from the root, shard its number in order of paths.

    Bytes are those of the UTF-8 text, null counting as none. A leaf holds at most target_bytes, and at most the
    least_shards-th part of all bytes, so that a small table is spread too, unless all its rows agree
    in every dimension, which is not split further. Null dimensions are below all values; repeated rows and ties fall
    on the same side. Rows with a null doc_id are placed too. An empty table gives an empty result. Columns
    other than doc_id, text and the dimensions are not looked at.
    """
    ship(docs.sparkSession)
    rows = cut(ranked(docs, numbers, categories).withColumn("node", F.lit("")))
    dims = [f"d{i}" for i in range(len(numbers) + len(categories))]
    scale, final = None, []
    while True:
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), *(F.min(c).alias(f"lo_{c}") for c in dims), *(F.max(c).alias(f"hi_{c}") for c in dims)).collect()
        if not stats:
            break
        if scale is None:
            target_bytes = min(target_bytes, max(1, -(-sum(s.b for s in stats) // least_shards)))
        ends = {s.node: (np.array([s[f"lo_{c}"] for c in dims], np.int64), np.array([s[f"hi_{c}"] for c in dims], np.int64)) for s in stats}
        if scale is None:
            scale = np.maximum(1, ends[""][1] - ends[""][0]).astype(np.float64)
        cuts = {}
        for s in stats:
            d = plan([ends[s.node]], scale)[0] if s.b > target_bytes and s.n > local_rows else None
            if d is not None:
                cuts[s.node] = (d, int(ends[s.node][0][d]), int(ends[s.node][1][d]))
        waiting = [s.node for s in stats if s.node not in cuts]
        if not cuts:
            final.append(rows)
            break
        side = small(docs.sparkSession.createDataFrame([(k,) for k in cuts], "node string"), 64)
        splitting = rows.join(side, "node", "left_semi")
        if waiting:
            final.append(rows.join(side, "node", "left_anti"))
        at = medians(splitting, cuts)
        where = docs.sparkSession.createDataFrame([(k, cuts[k][0], v) for k, v in at.items()], "node string, d int, middle long")
        value = F.element_at(F.array(*dims), F.col("d") + 1)
        rows = cut(splitting.join(F.broadcast(where), "node").withColumn("node", F.concat("node", F.when(value <= F.col("middle"), "0").otherwise("1"))).drop("d", "middle"))
    out = None
    for part in final:
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select("doc_id", "bytes", F.lit("").alias("leaf"), F.lit(0).cast("long").alias("shard"))
    size = scale

    def finish(part: pa.Table) -> pa.Table:
        leaf = np.empty(len(part), object)
        points = np.stack([part[c].to_numpy() for c in dims], 1)
        for path, at in split_local(points, part["bytes"].to_numpy(), target_bytes, size):
            leaf[at] = part["node"][0].as_py() + path
        return pa.table({"doc_id": part["doc_id"], "bytes": part["bytes"], "leaf": pa.array(leaf, pa.string())})

    done = cut(out.groupBy("node").applyInArrow(finish, "doc_id long, bytes long, leaf string"))
    leaves = done.groupBy("leaf").agg(F.lit(1).alias("x")).select("leaf", (F.row_number().over(Window.orderBy("leaf")) - 1).cast("long").alias("shard"))
    return done.join(small(cut(leaves), 64), "leaf").select("doc_id", "bytes", "leaf", "shard")
