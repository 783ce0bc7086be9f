"""Exact k nearest neighbours per group by cosine, without forming all pairs.

Unit vectors are compared by chord distance, which is a metric and orders like
the cosine. The points of a group are cut into about sqrt(n) cells around pivots,
and the cells into about n ** 0.25 regions around some of these pivots; both
numbers grow with the group. A point is placed by its distances to the regions
and to the pivots of one region. The triangle inequality then bounds, for every
query, how far its k-th neighbour can be, which regions and which of their cells
can hold it, and inside a cell how far a point may lie from the two pivots.
Cells of many points are joined in parts. Nothing is approximated or capped.
The pivots, about sqrt(n) rows a group, are broadcast; the points stay in place.

Equal vectors are folded first, on both sides: a point vector keeps its k
smallest ids, a query vector is answered once for all its owners. A group of
copies therefore costs as much as one vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.joins import join_few
from patronlens.functions.lineage import cut

# Points of a cell that one key of the last join holds.
PART_POINTS = 4096
# Slack of the pruning bounds against rounding; it only ever keeps a few more pairs.
SLACK = 1e-7


def _dot(left: Sequence[Column], right: Sequence[Column]) -> Column:
    total = None
    for a, b in zip(left, right, strict=True):
        total = a * b if total is None else total + a * b
    return total


def _chord(left: Sequence[Column], right: Sequence[Column]) -> Column:
    total = None
    for a, b in zip(left, right, strict=True):
        total = (a - b) * (a - b) if total is None else total + (a - b) * (a - b)
    return F.sqrt(total)


def _columns(names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def unit(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows scaled to length one; a zero vector has no direction and no positive cosine, so it is left out."""
    length = F.sqrt(_dot(_columns(names), _columns(names)))
    long_enough = frame.withColumn("_len", length).where(F.col("_len") > 0)
    return long_enough.withColumns({n: F.col(n) / F.col("_len") for n in names}).drop("_len")


def _distinct_points(points: DataFrame, group: Sequence[str], names: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group, *names).orderBy("id")
    few = points.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    # at most k ids per vector are left here
    return few.groupBy(*group, *names).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _pivots(points: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """About sqrt(n) pivots a group, drawn by hash; of these about n ** 0.25 head a region. Each group has one at least."""
    drawn = points.select(*group, *names, F.xxhash64(*names).alias("cell")).withColumn("_u", F.shiftrightunsigned("cell", 11) / F.lit(2.0 ** 53))
    sizes = points.select(*group, (F.shiftrightunsigned(F.xxhash64(*names), 11) / F.lit(2.0 ** 53)).alias("_u")).groupBy(*group).agg(
        F.count("*").cast("double").alias("_n"), F.min("_u").alias("_least"))
    joined = join_few(drawn, sizes, group)
    chosen = joined.where(F.col("_u") <= F.greatest(F.pow("_n", F.lit(-0.5)), "_least"))
    # one pivot a name, should two vectors have the same hash
    return chosen.groupBy(*group, "cell").agg(
        F.min(F.struct(*names)).alias("_p"), F.max(F.col("_u") <= F.greatest(F.pow("_n", F.lit(-0.75)), "_least")).alias("heads")).select(
        *group, "cell", "heads", *[F.col(f"_p.{n}").alias(f"p_{n}") for n in names])


def _placed(points: DataFrame, pivots: DataFrame, group: Sequence[str], names: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (points with their region, cell, part and distances), outlines of the cells and areas of the regions."""
    own, pivot, head = _columns(names), _columns(names, "p_"), _columns(names, "r_")
    heads = pivots.where("heads").select(*group, F.col("cell").alias("region"), *[F.col(f"p_{n}").alias(f"r_{n}") for n in names])
    to_head = _chord(pivot, head)
    inside = cut(join_few(pivots, heads, group).groupBy(*group, "cell", *[f"p_{n}" for n in names]).agg(
        F.min_by("region", F.struct(to_head, "region")).alias("region")))
    away = _chord(own, head)
    near = join_few(points, heads, group).groupBy(*group, *names, "ids").agg(
        F.min(away).alias("away"), F.min_by("region", F.struct(away, "region")).alias("region"))
    reach = _chord(own, pivot)
    cells = cut(join_few(near, inside, [*group, "region"]).groupBy(*group, *names, "ids", "away", "region").agg(
        F.min(reach).alias("reach"), F.min_by("cell", F.struct(reach, "cell")).alias("cell")))
    outlines = cells.groupBy(*group, "cell").agg(
        F.max("reach").alias("radius"), F.sum(F.size("ids")).alias("n"), F.ceil(F.count("*") / F.lit(PART_POINTS)).cast("int").alias("parts"))
    outlines = cut(outlines.join(inside, [*group, "cell"]))
    areas = cells.groupBy(*group, "region").agg(F.max("away").alias("extent"), F.sum(F.size("ids")).alias("n"))
    return cells, outlines, cut(areas.join(heads, [*group, "region"]))


def _tightened(rough: DataFrame, cells: DataFrame, group: Sequence[str], names: Sequence[str], k: int) -> DataFrame:
    """Limits lowered to the k-th distance inside the closest cell that holds k points."""
    asked = rough.where(F.col("home").isNotNull()).select("q", *group, F.col("home").alias("cell"), *[F.col(n).alias(f"q_{n}") for n in names])
    chord = _chord(_columns(names, "q_"), _columns(names))
    near = asked.join(cells.select(*group, "cell", *names), [*group, "cell"]).select("q", chord.alias("chord"))
    ranked = near.withColumn("_rn", F.row_number().over(Window.partitionBy("q").orderBy("chord"))).where(F.col("_rn") <= k)
    reached = ranked.groupBy("q").agg(F.max("chord").alias("kth"), F.count("*").alias("_n")).where(F.col("_n") == k)
    return rough.drop("home").join(reached.drop("_n"), "q", "left").withColumn("limit", F.least("limit", "kth")).drop("kth")


def met(points: DataFrame, queries: DataFrame, group: Sequence[str], names: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct query vectors with their number q, and every pair of query and point vector that the bounds leave."""
    own, pivot, head = _columns(names), _columns(names, "p_"), _columns(names, "r_")
    folded = cut(_distinct_points(points.select("id", *group, *names), group, names, k))
    cells, outlines, areas = _placed(folded, cut(_pivots(folded, group, names)), group, names)

    # a region, then a cell, that holds k points bounds the distance of the k-th neighbour
    asked = cut(queries.select(*group, *names).distinct().withColumn("q", F.monotonically_increasing_id()))
    full, way = F.col("n") >= k, _chord(own, head)
    far = way + F.col("extent")
    bound = F.coalesce(F.min(F.when(full, far)), F.when(F.sum("n") >= k, F.max(far)), F.lit(2.0))
    rough = join_few(asked, areas, group).groupBy("q", *group, *names).agg(
        # a chord of sqrt(2) is a cosine of zero, beyond which nothing counts
        F.least(bound, F.lit(2.0 ** 0.5)).alias("limit"), F.min_by("region", F.when(full, F.struct(way, "region"))).alias("region"))
    way = _chord(own, pivot)
    rough = cut(join_few(rough, outlines, [*group, "region"], "left").groupBy("q", *group, *names, "limit").agg(
        F.min(F.when(full, way + F.col("radius"))).alias("_bound"), F.min_by("cell", F.when(full, F.struct(way, "cell"))).alias("home")))
    rough = rough.withColumn("limit", F.least("limit", "_bound")).drop("_bound")
    limits = cut(_tightened(rough, cells, group, names, k))

    within = F.col("limit") + SLACK
    areas_met = join_few(limits, areas.drop("n"), group).withColumn("way_r", _chord(own, head)).where(F.col("way_r") - F.col("extent") <= within)
    areas_met = areas_met.select("q", *group, *names, "limit", "region", "way_r")
    probes = join_few(areas_met, outlines.drop("n"), [*group, "region"]).withColumn("way", way).where(F.col("way") - F.col("radius") <= within)
    probes = probes.select("q", *group, "cell", "way", "way_r", "limit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           *[F.col(n).alias(f"q_{n}") for n in names])
    sizes = outlines.select(*group, "cell", "parts")
    dealt = join_few(cells.drop("region"), sizes, [*group, "cell"]).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(1), *names), F.col("parts")).cast("int")).drop("parts")
    pairs = probes.join(dealt, [*group, "cell", "part"]).where(
        (F.abs(F.col("way") - F.col("reach")) <= within) & (F.abs(F.col("way_r") - F.col("away")) <= within))
    return asked, pairs


def nearest_lists(points: DataFrame, queries: DataFrame, group: Sequence[str], names: Sequence[str], k: int = 5) -> DataFrame:
    """The k most similar points of every query with a positive cosine, as one list a query.

    `points` and `queries` have `id`, the group columns and unit vectors in `names`.
    Returns (group, id, found), where found holds (position, neighbour_id, similarity) by position.
    """
    group, names = list(group), list(names)
    asked, pairs = met(points, queries, group, names, k)
    cosine = _dot(_columns(names, "q_"), _columns(names))
    close = pairs.withColumn("similarity", cosine).where(
        (F.col("similarity") > 0) & (F.col("similarity") >= 1 - F.col("limit") * F.col("limit") / 2 - SLACK))
    by_query = Window.partitionBy("q")
    best = close.select("q", "similarity", "ids").withColumn(
        "_rn", F.row_number().over(by_query.orderBy(F.desc("similarity"), F.col("ids")[0]))).where(F.col("_rn") <= k)
    # at most k vectors with at most k ids each
    single = best.select("q", "similarity", F.explode("ids").alias("neighbour_id"))
    ranked = single.withColumn("position", F.row_number().over(by_query.orderBy(F.desc("similarity"), "neighbour_id"))).where(
        F.col("position") <= k)
    packed = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("position", "neighbour_id", "similarity"))).alias("found"))
    packed = packed.join(asked, "q").drop("q")
    # a list meets its owners once; repeated for salts, the lists were the largest shuffle of all
    answered = queries.select("id", *group, *names).join(packed, [*group, *names])
    return answered.select(*group, "id", "found")


def nearest(points: DataFrame, queries: DataFrame, group: Sequence[str], names: Sequence[str], k: int = 5) -> DataFrame:
    """The same with a row a neighbour: (group, id, neighbour_id, similarity, position)."""
    lists = nearest_lists(points, queries, group, names, k)
    return lists.select(*group, "id", F.inline("found")).select(*group, "id", "neighbour_id", "similarity", "position")
