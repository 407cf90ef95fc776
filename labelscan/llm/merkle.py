"""Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots, built by butterfly exchange.

Leaves get their position in their group from a sort by ranges: each task numbers its own rows, and running sums of the
tasks' counts move them to their place, so that no group is ordered in one task. Blocks of FANOUT**HEIGHT consecutive
leaves, aligned with the tree, are the parties of the exchange. Each hashes its own subtree. Then, round by round, a
block sends the root it has reached to its counterparts in the other two members of its aligned run, and all of them hash
the run's root by themselves: ancestors are worked out again in every block below them, and each block collects the upper
part of its leaves' proofs on the way up. There is no way down. A run's last member may have fewer blocks than the others:
its blocks then send to more than one counterpart. A round is one shuffle of a small row for each block and counterpart.

A path is an array of steps from a leaf to the root; a step holds the digests left and right of one's own in its run,
each 64 hexadecimal digits, one after the other, or "" without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelscan.llm.shared import plus, stored
from labelscan.operators.order import numbered

FANOUT, HEIGHT = 3, 7
STEP = "array<struct<left:string,right:string>>"


def record(*columns: Column) -> Column:
    """Digest of values: "-" for null, else the number of their UTF-8 bytes, a colon and the value, one after the other."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, from the leaf's level to the root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    """Nodes of each level: up to a single one, or through so many levels whatever is left."""
    levels = [nodes]
    while len(nodes) > 1 or len(levels) <= height:
        nodes = [sha256("".join(nodes[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)]
        levels.append(nodes)
    return levels


def _steps(levels: list[list[str]]) -> pa.Array:
    """Paths of all leaves within the levels."""
    n, depth = len(levels[0]), len(levels) - 1
    sides = np.empty((2, n, depth), object)
    for k, nodes in enumerate(levels[:-1]):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        around = [("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))]
        at = np.arange(n) // FANOUT**k
        for side in (0, 1):
            sides[side, :, k] = np.array([x[side] for x in around], object)[at]
    both = pa.StructArray.from_arrays([pa.array(s.ravel(), pa.string()) for s in sides], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * depth, pa.int32()), both)


def local(rows: DataFrame, group: str, paths: bool, height: int = HEIGHT) -> DataFrame:
    """Subtrees of the blocks of numbered rows: (group, _block, _blocks, root) for each block, or rows plus _block and path.

    A task holds the rows of one block at a time.
    """
    size = FANOUT**height
    rows = rows.withColumn("_block", F.floor(F.col("_at") / size)).withColumn("_blocks", F.ceil(F.col("_size") / size))
    schema = plus(rows, f"path {STEP}") if paths else StructType([rows.schema[group], *StructType.fromDDL("_block long, _blocks long, root string").fields])

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        levels = _levels(block.column("digest").to_pylist(), height if block.column("_blocks")[0].as_py() > 1 else 0)
        if paths:
            return pa.RecordBatch.from_arrays([*block.columns, _steps(levels)], [*block.schema.names, "path"])
        return pa.RecordBatch.from_arrays([*[block.column(c).slice(0, 1) for c in (group, "_block", "_blocks")], pa.array(levels[-1])], [group, "_block", "_blocks", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column("_at").to_numpy()
            starts = np.flatnonzero(at % size == 0)  # a block begins here
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(at)], strict=True):
                if a in starts and held:
                    yield finish(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield finish(held)

    return rows.repartition(group, "_block").sortWithinPartitions(F.col(group).asc_nulls_first(), "_at").mapInArrow(run, schema)


def butterfly(state: DataFrame, group: str) -> DataFrame:
    """(group, _block, _blocks, root) -> (group, _block, root, path): every block's own copy of its group's root and the way there."""
    state = state.withColumn("path", F.array().cast(STEP))
    most = state.agg(F.max("_blocks")).first()[0] or 1
    width = 1
    while width < most:  # nodes of this round stand for `width` blocks each
        node, last = F.floor(F.col("_block") / width), F.ceil(F.col("_blocks") / width) - 1
        size = lambda p: F.least(F.lit(width), F.col("_blocks") - p * width)  # noqa: B023, E731
        sent = state.withColumn("_node", node).withColumn("_last", last).withColumn("_slot", F.col("_block") % width).withColumn("_digit", F.col("_node") % FANOUT)
        sent = sent.withColumn("_to", F.explode(F.sequence(F.col("_node") - F.col("_digit"), F.least(F.col("_node") - F.col("_digit") + FANOUT - 1, F.col("_last")))))
        own = F.col("_to") == F.col("_node")
        sent = sent.where(own | (F.col("_slot") < size(F.col("_to"))))
        slots = F.when(own, F.array("_slot")).otherwise(F.sequence("_slot", size(F.col("_to")) - 1, size(F.col("_node"))))
        sent = sent.withColumn("_own", own).withColumn("_target", F.explode(slots))
        got = sent.groupBy(group, (F.col("_target") + F.col("_to") * width).alias("_block")).agg(
            F.first("_blocks").alias("_blocks"), F.first("_last").alias("_last"), F.array_sort(F.collect_list(F.struct("_digit", "root"))).alias("_run"),
            F.first(F.when(F.col("_own"), F.struct("_digit", "root", "path")), ignorenulls=True).alias("_mine"),
        )
        side = lambda keep: F.array_join(F.transform(F.filter("_run", keep), lambda x: x["root"]), "")
        step = F.struct(side(lambda x: x["_digit"] < F.col("_mine._digit")).alias("left"), side(lambda x: x["_digit"] > F.col("_mine._digit")).alias("right"))
        risen = F.col("_last") > 0  # several nodes remained
        root = F.when(risen, F.sha2(side(lambda x: F.lit(True)), 256)).otherwise(F.col("_mine.root"))
        path = F.when(risen, F.concat("_mine.path", F.array(step))).otherwise(F.col("_mine.path"))
        state = got.select(group, "_block", "_blocks", root.alias("root"), path.alias("path"))
        width *= FANOUT
    return state.select(group, "_block", "root", "path")


def roots(leaves: DataFrame, group: str, height: int) -> DataFrame:
    """(_group, _of, root, _upper) of each block of numbered leaves: its group's root and the way there from the block's."""
    state = butterfly(stored(local(leaves, group, False, height), "blocks"), group)
    return stored(state.select(F.col(group).alias("_group"), F.col("_block").alias("_of"), "root", F.col("path").alias("_upper")), "roots")


def tree(rows: DataFrame, group: str, order: list[str], height: int = HEIGHT) -> DataFrame:
    """rows (with a column digest) plus root, that of their group's tree, and path, the way there."""
    leaves = numbered(rows, group, order)
    return _joined(local(leaves, group, True, height), group, roots(leaves, group, height))


def _joined(leaves: DataFrame, group: str, upper: DataFrame) -> DataFrame:
    found = leaves.join(upper, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")))
    return found.withColumn("path", F.concat("path", "_upper")).drop("_upper", "_group", "_of", "_block", "_blocks", "_at", "_size")


def manifest(rows: DataFrame, group: str, order: list[str], height: int = HEIGHT) -> DataFrame:
    """rows plus subroot, root and path; rows have a column digest, none named root, subroot or path, none that starts with _.

    A group's leaves ascend by `order`, nulls first, then by digest: rows that repeat a key each are a leaf. The groups'
    subroots ascend by group, null first, bytewise, and make the tree of the root in the same way; path leads from a leaf
    by its subroot to the root. An empty table has no root and no rows.
    """
    leaves = numbered(stored(rows, "leaves"), group, [*order, "digest"])
    upper = roots(leaves, group, height).withColumnRenamed("root", "subroot")
    tops = upper.where("_of = 0").select(F.lit(0).alias("all"), F.col("_group").alias("top"), F.col("subroot").alias("digest"))
    outer = stored(tree(tops, "all", ["top"], height).select("top", "root", F.col("path").alias("_way")), "root")
    upper = upper.join(outer, F.col("_group").eqNullSafe(F.col("top")))
    upper = upper.select("_group", "_of", "subroot", "root", F.concat("_upper", "_way").alias("_upper"))
    return _joined(local(leaves, group, True, height), group, upper)
