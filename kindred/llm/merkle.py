"""Merkle manifest of a dataset: one digest for each row, group and for all, and proofs.

Rows are leaves. In each group they are numbered in order of their ids, by a range
partitioning, so that no group has to lie in one task. Then the tree is built bottom-up,
a written table for each level: runs of `fanout` nodes, with the digest of each run. Groups'
roots are the leaves of a last tree in the same way. Proofs go top-down: each level joins the
proofs of its runs, which are those of the nodes above, and each child puts its siblings in front.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import numbered, written


def digest(*parts: Column) -> Column:
    """SHA-256 of strings one behind the other, in lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of fields read alike: its length in bytes and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str], changed: Mapping[str, Column] | None = None) -> Column:
    """Digest of a row's columns, of which some may be replaced."""
    return digest(*(field((changed or {}).get(c, F.col(c))) for c in columns))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda low, step: digest(step["before"], low, step["after"]))


def siblings(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _runs(nodes: DataFrame, kept: Sequence[str], fanout: int) -> DataFrame:
    """Runs of (group, pos, n, h): their children in order, and their digest; a node without any others is as it is."""
    up = F.floor(F.col("pos") / F.lit(fanout)).cast("long") if fanout & (fanout - 1) else F.shiftright("pos", fanout.bit_length() - 1)
    runs = nodes.groupBy("group", up.alias("pos"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "h", *kept))).alias("children"))
    whole = F.sha2(F.array_join(F.transform("children", lambda c: c["h"]), ""), 256)
    return runs.select("group", "pos", F.ceil(F.col("n") / fanout).cast("long").alias("n"), (F.col("n") > 1).alias("hashed"), F.when(F.col("n") > 1, whole).otherwise(F.col("children")[0]["h"]).alias("h"), "children")


def _tree(nodes: DataFrame, kept: Sequence[str], fanout: int) -> list[DataFrame]:
    """Levels of all groups' trees, the lowest one first, as written tables; a group ends where it has one run."""
    levels = [written(_runs(nodes, kept, fanout))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(_runs(levels[-1].where("n > 1").select("group", "pos", "n", "h"), (), fanout)))
        most = -(-most // fanout)
    return levels


def _pushed(runs: DataFrame, proofs: DataFrame) -> DataFrame:
    """The children of runs, with all that their runs have in `proofs`, and their siblings before that."""
    both = runs.select("group", "pos", "hashed", "children").join(proofs, ["group", "pos"])
    both = both.select("*", F.posexplode("children").alias("__i", "child"))
    text = lambda begin, size: F.array_join(F.transform(F.slice("children", begin, size), lambda c: c["h"]), "")
    step = F.struct(text(F.lit(1), F.col("__i")).alias("before"), text(F.col("__i") + 2, F.size("children")).alias("after"))
    longer = F.when(F.col("hashed"), F.concat(F.array(step), "proof")).otherwise(F.col("proof"))
    return both.withColumn("proof", longer).drop("children", "hashed", "__i")


@dataclass
class Manifest:
    """A built tree.

    root: digest of all rows, None if there are none; levels, tops: the runs of the
    groups' trees and of the tree of their roots, lowest level first.
    """

    root: str | None
    levels: list[DataFrame]
    tops: list[DataFrame]

    def proofs(self, *kept: str) -> DataFrame:
        """(kept columns, leaf, subroot, root, proof) of each row.

        proof: array of (before, after), for each level the digests of the leaf's or run's
        siblings on its left and on its right, from the leaf to the root.
        """
        none = F.array().cast("array<struct<before:string,after:string>>")
        above = self.tops[-1].select("group", "pos", none.alias("proof"))
        for runs in reversed(self.tops):
            above = _pushed(runs, above).select(F.lit("").alias("group"), F.col("child.pos").alias("pos"), "child", "proof")
            last, above = above, above.drop("child")
        # each group's root: the one node of its last level
        roots = last.select(F.col("child.own").alias("group"), F.lit(0).cast("long").alias("pos"), F.col("child.h").alias("subroot"), "proof")
        above = None
        for runs in reversed(self.levels):
            ended = runs.where("n = 1").select("group", "pos").join(roots, ["group", "pos"])
            above = ended if above is None else above.unionByName(ended)
            below = _pushed(runs, above)
            above = below.select("group", F.col("child.pos").alias("pos"), "subroot", "proof")
        return below.select(*(F.col(f"child.{c}").alias(c) for c in kept), F.col("child.h").alias("leaf"), "subroot", F.lit(self.root).cast("string").alias("root"), "proof")


def build(docs: DataFrame, columns: Sequence[str], *, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 8, kept: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of `docs`: digests of `columns` of each row, in groups by `group_col`.

    Leaves of a group are in order of the id, null first, and of rows with one id in order
    of their digests; of equal rows each is a leaf. Groups are in order of their names'
    bytes; null is a group of its own, before all others (an empty name comes second). A run is the digest
    of its nodes, of up to `fanout`, as hex text one behind the other; a lone leaf is
    its group's root, and a lone group's root the root. Null values, empty and long texts
    are fields as any other; other columns don't matter. An empty table has no root and no proofs.
    kept: columns computed along with the digests, for `Manifest.proofs`; the id is kept as well.

    The text is read once, in the first step; all others go with digests only. What
    the driver gets is the root and counts of levels. Tables lie in the shared
    folder as long as the driver's Python runs.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    kept = {id_col: F.col(id_col)} | dict(kept or {})
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = written(docs.select(group.alias("group"), F.col(id_col).alias("__id"), leaf(columns).alias("h"), *(c.alias(name) for name, c in kept.items())))
    levels = _tree(numbered(rows, "group", ("__id", "h")), list(kept), fanout)
    ends = levels[0].where("n = 1")
    for runs in levels[1:]:
        ends = ends.drop("children").unionByName(runs.where("n = 1").drop("children"))
    roots = written(ends.select(F.lit("").alias("group"), F.col("group").alias("own"), "h"))
    tops = _tree(numbered(roots, "group", ("own",)), ("own",), fanout)
    top = tops[-1].where("n = 1").select("h").first()
    return Manifest(top[0] if top else None, levels, tops)


__all__ = ["Manifest", "build", "digest", "field", "fold", "leaf", "siblings"]
