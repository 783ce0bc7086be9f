"""Merkle manifest of a data set: a root digest, and for every row a proof against it.

Rows are leaves; in each group (a language) they ascend by id, and every `ARITY` neighbours
become the digest of their digests, level by level, until one node, the group's root, is
left. The group roots, ordered by group, form one more tree of the same kind above them.

Checkpoint and recompute: only every `STEP`-th level is written. Between two written levels
lie aligned subtrees of ARITY**STEP nodes. To build, each subtree is folded to its top node;
to extract proofs, each subtree's missing interior nodes are made again from its stored
nodes, every node's siblings are emitted, and the interior nodes are discarded with the
plan's row. Proofs go from the root down: a subtree takes the siblings above it from the
proof of its top node, one join by (group, subtree), in which every key occurs once.

No group is gathered anywhere: positions come from `ordering.ranked`, a subtree holds at most
512 digests, and a level has 1/512 of the rows of the one below. Texts are read once, for the
leaf digests; only digests and the kept columns are shuffled.

Defined results: a null field counts as `-` and is told apart from empty text, which is `0:`;
null ids and null groups come first; rows that repeat an id are ordered by leaf digest; rows
that repeat all fields are leaves of their own; a group of one row has its leaf as root; an
empty table has neither groups nor proofs. Texts of any length are hashed whole. Other columns
of the table are ignored; kept columns that clash with a result column come back as `<name>_in`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import stored
from patronlens.llm.ordering import ranked

ARITY = 8
STEP = 3
SPAN = ARITY**STEP
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEPS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """UTF-8 byte count, colon, value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings along its path lead to."""
    return F.aggregate(path, start, lambda node, step: digest(step["left"], node, step["right"]))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _hashed(nodes: Column, block: Column) -> Column:
    """Whether this level of a subtree is hashed again: nodes of one subtree alone stop at one node."""
    return (block > 0) | (F.size(nodes) > 1)


def _up(nodes: Column, block: Column) -> Column:
    """The next level. `nodes` is bound by a lambda, so that it is made once and not once for each use."""

    def hashed(own: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / ARITY).cast("int"))
        joined = F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(own, r * ARITY + 1, F.lit(ARITY)), ""), 256))
        return F.when(_hashed(own, block), joined).otherwise(own)

    return F.transform(F.array(nodes), hashed)[0]


def _subtrees(level: DataFrame, group: list[str], payload: list[str]) -> DataFrame:
    """One row a subtree: its stored nodes in order, and the levels `_n1`, `_n2`, ... made from them."""
    block = F.floor(F.col("_idx") / SPAN).cast("long").alias("_block")
    rows = level.groupBy(*group, block).agg(F.sort_array(F.collect_list(F.struct("_idx", "_node", *payload))).alias("_own"))
    rows = rows.withColumn("_n0", F.col("_own._node"))
    for k in range(STEP):
        rows = rows.withColumn(f"_n{k + 1}", _up(F.col(f"_n{k}"), F.col("_block")))
    return rows


@dataclass
class Tree:
    """Written levels of one tree a group: `levels[k]` holds every node of level STEP*k; the last holds the roots."""

    levels: list[DataFrame]
    group: list[str]
    payload: list[str]

    def roots(self) -> DataFrame:
        return self.levels[-1].select(*self.group, F.col("_node").alias("_root"))

    def paths(self, above: DataFrame, carried: list[str]) -> DataFrame:
        """(group, _idx, _node, payload, _path, carried): every leaf with its siblings up to the root and beyond.

        `above` has one row a group: the `_path` that goes on beyond the group's root, and the
        columns `carried`, which come down to all leaves.
        """
        upper = above.select(*self.group, F.lit(0).cast("long").alias("_idx"), "_path", *carried)
        for depth in range(len(self.levels) - 2, -1, -1):
            payload = self.payload if depth == 0 else []
            tops = upper.select(*[F.col(g).alias(f"{g}_up") for g in self.group], F.col("_idx").alias("_at"), F.col("_path").alias("_above"), *carried)
            same = [F.col(g).eqNullSafe(F.col(f"{g}_up")) for g in self.group]
            found = _subtrees(self.levels[depth], self.group, payload).join(tops, [F.col("_block") == F.col("_at"), *same])
            found = found.select("*", F.posexplode("_own").alias("_j", "_member"))
            steps = []
            for k in range(STEP):
                nodes, at = F.col(f"_n{k}"), F.floor(F.col("_j") / ARITY**k).cast("int")
                own = (at % ARITY).cast("int")
                left = F.array_join(F.slice(nodes, at - own + 1, own), "")
                right = F.array_join(F.slice(nodes, at + 2, F.lit(ARITY - 1) - own), "")
                steps.append(F.when(_hashed(nodes, F.col("_block")), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_STEPS)))
            upper = found.select(
                *self.group, F.col("_member._idx").alias("_idx"), F.col("_member._node").alias("_node"), *[F.col(f"_member.{p}").alias(p) for p in payload],
                F.concat(*steps, F.col("_above")).alias("_path"), *carried,
            )
        return upper


def tree(rows: DataFrame, group: list[str], order: list[str], payload: list[str]) -> Tree:
    """Trees over the digests `_node` of the rows; `payload` columns stay with the leaves."""
    levels = [ranked(rows.select(*dict.fromkeys([*group, *order, *payload, "_node"])), group, [*order, "_node"])]
    while True:
        tops = _subtrees(levels[-1].select(*group, "_idx", "_node"), group, [])
        levels.append(stored(tops.select(*group, F.col("_block").alias("_idx"), F.col(f"_n{STEP}")[0].alias("_node"))))
        if not levels[-1].where("_idx > 0").limit(1).count():
            return Tree(levels, group, payload)


@dataclass
class Manifest:
    """Trees of all groups and the tree over their roots."""

    trees: Tree
    top: Tree
    keep: list[str]

    def root(self) -> DataFrame:
        """One row `root`; none for an empty table."""
        return self.top.roots().select(F.col("_root").alias("root"))

    def group_roots(self) -> DataFrame:
        return self.trees.roots().select(F.col("_g").alias("group"), F.col("_root").alias("root"))

    def proofs(self) -> DataFrame:
        """Every row: kept columns, `leaf`, `subroot`, `root`, and `path`, its siblings level by level as (left, right)."""
        whole = self.top.roots().select("_all", F.array().cast(_STEPS).alias("_path"), F.col("_root").alias("_whole"))
        above = self.top.paths(whole, ["_whole"]).select("_g", "_path", F.col("_node").alias("_sub"), "_whole")
        found = self.trees.paths(above, ["_sub", "_whole"])
        own = ["leaf", "subroot", "root", "path"]
        kept = [F.col(f"_k{i}").alias(f"{c}_in" if c in own else c) for i, c in enumerate(self.keep)]
        return found.select(*kept, F.col("_node").alias("leaf"), F.col("_sub").alias("subroot"), F.col("_whole").alias("root"), F.col("_path").alias("path"))


def manifest(rows: DataFrame, fields: list[str] | None = None, group: str = "lang", order: str = "doc_id", keep: list[Column] | None = None) -> Manifest:
    """Write the manifest of a table: leaves over `fields`, one tree a value of `group`, ordered by `order`."""
    kept = keep if keep is not None else [F.col(order)]
    names = rows.select(*kept).columns
    leaves = rows.select(
        F.col(group).alias("_g"), F.col(order).alias("_o"), leaf([F.col(c) for c in fields or FIELDS]).alias("_node"), *[c.alias(f"_k{i}") for i, c in enumerate(kept)]
    )
    trees = tree(stored(leaves), ["_g"], ["_o"], [f"_k{i}" for i in range(len(kept))])
    subs = trees.roots().select(F.lit(0).alias("_all"), "_g", F.col("_root").alias("_node"))
    return Manifest(trees, tree(subs, ["_all"], ["_g"], ["_g"]), names)
