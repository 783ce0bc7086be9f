"""Customer profiles: one wide row per customer from canonical events.

Shape of the job:

* `activity_cells` reads the events once, places their few needed columns by
  customer and combines them there into small cells. Events of a customer hardly
  ever meet in a task before that, so combining earlier would fill the memory of
  a task with its whole input and save nothing.
* `facet_rows` and `customer_metrics` fold the cells into totals, modes and the
  top category; both reuse the placement by customer.
* `interval_stats` handles gaps between purchases without ever placing all
  purchases of a customer in one task (see there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import (
    MICROS_PER_DAY, clamp, mobile_exact, money_avg, non_empty, ratio, whole_days,
)
from patronlens.functions.joins import placed
from patronlens.functions.picks import pick_first, ranked_first

PAGE_VIEWS = ("view_category", "view_item")
CATEGORY_PURCHASES = ("purchase", "purchase_item")
#: Columns of the leading level-one category: its score, purchases and share of all scores.
LEADING = ("top_category_score", "top_category_purchases", "category_concentration")


def amount(events: DataFrame) -> Column:
    """Zero or missing total falls through to the order total."""
    return F.coalesce(F.nullif(events["total_amount"], F.lit(0)), events["order_total"])


def activity_cells(events: DataFrame, clock: bool = True, categories: bool = True) -> DataFrame:
    """Additive measures per customer and cell, from one scan of the events.

    A cell is either (weekday, hour, device) or a category path, so an event adds
    to at most two cells, and a customer's cells are bounded by 168 device-hours
    plus the catalogue, whatever the number of events. The events are placed by
    customer before they are unfolded into cells: every grouping by customer, or by
    customer and more, finds them there and shuffles nothing. A customer with very
    many events is read by one task, which holds only its cells.
    """
    top = F.coalesce(non_empty(F.col("category_level_1")), non_empty(F.col("product_category")))
    path = {"l1": top, "l2": non_empty(F.col("category_level_2")), "l3": non_empty(F.col("category_level_3"))}
    needed = ["customer_id", "ts", "event_type", *[c.alias(n) for n, c in path.items()]]
    if clock:
        needed += [amount(events).alias("amount"), non_empty(F.col("device_type")).alias("device")]
    own = events.select(*needed)
    some = F.coalesce(*path).isNotNull()
    own = placed(own if clock else own.where(some), "customer_id")
    kind = F.col("event_type")
    viewed, bought, taken = kind.isin(*PAGE_VIEWS), kind == "purchase", kind.isin(*CATEGORY_PURCHASES)
    blank, whole = F.lit(None).cast("string"), F.lit(None).cast("int")
    shapes = []
    if clock:
        shapes.append(F.struct(
            F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"), F.col("device").alias("device"), *[blank.alias(n) for n in path]))
    if categories:
        shapes.append(F.when(some, F.struct(
            whole.alias("weekday"), whole.alias("hour"), blank.alias("device"), *[F.col(n).alias(n) for n in path])))
    flat = own.select("customer_id", "ts", "event_type", *(["amount"] if clock else []), F.explode(F.array(*shapes)).alias("c"))
    measures = [F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.count_if(viewed).alias("views")]
    if clock:
        measures += [
            F.max("ts").alias("last_ts"), F.count_if(bought).alias("purchases"),
            F.sum(F.when(bought, F.col("amount"))).alias("revenue"),
            F.min(F.when(bought, F.col("ts"))).alias("first_purchase"), F.max(F.when(bought, F.col("ts"))).alias("last_purchase"),
            F.count_if(kind == "refund").alias("refunds"), F.count_if(kind == "session_start").alias("sessions"),
            F.count_if(kind == "view_item").alias("item_views"), F.count_if(kind == "add_to_cart").alias("carts"),
        ]
    if categories:
        weight = F.when(viewed, 1).when(kind == "add_to_cart", 2).when(taken, 5).otherwise(0)
        measures += [
            F.sum(weight).alias("engagement"), F.count_if(taken).alias("item_purchases"),
            F.min(F.when(weight > 0, F.col("ts"))).alias("first_engaged"),
        ]
    return flat.where(F.col("c").isNotNull()).groupBy(
        "customer_id", *[F.col(f"c.{k}").alias(k) for k in ("weekday", "hour", "device", "l1", "l2", "l3")]).agg(*measures)


def facet_rows(cells: DataFrame) -> DataFrame:
    """Cells folded into one row per (customer, facet, level, value).

    Facets are 'all', 'weekday', 'hour', 'device' and 'category' with its level.
    """
    def facet(name: str, value: Column, level: int = 0) -> Column:
        return F.struct(F.lit(name).alias("facet"), F.lit(level).alias("level"), value.alias("value"))

    timed = F.col("weekday").isNotNull()
    facets = []
    if "purchases" in cells.columns:
        facets += [
            facet("all", F.when(timed, "")), facet("weekday", F.col("weekday").cast("string")),
            facet("hour", F.col("hour").cast("string")), facet("device", F.col("device")),
        ]
    if "engagement" in cells.columns:
        facets += [facet("category", F.col(f"l{i}"), i) for i in (1, 2, 3)]
    earliest, latest = ("first_ts", "first_purchase", "first_engaged"), ("last_ts", "last_purchase")
    keys = ("customer_id", "weekday", "hour", "device", "l1", "l2", "l3")
    folds = [
        (F.min if m in earliest else F.max if m in latest else F.sum)(m).alias(m) for m in cells.columns if m not in keys
    ]
    if "purchases" in cells.columns:
        folds += [
            F.sum(F.when(F.col("device").isNotNull(), F.col("n"))).alias("with_device"),
            F.sum(F.when(mobile_exact(F.col("device")), F.col("n")).otherwise(0)).alias("on_mobile"),
        ]
    spread = cells.withColumn("f", F.explode(F.array(*facets))).where(F.col("f.value").isNotNull())
    return spread.groupBy(
        "customer_id", F.col("f.facet").alias("facet"), F.col("f.level").alias("level"), F.col("f.value").alias("value")).agg(*folds)


def _mode(facet: str) -> Column:
    """Most frequent value; ties go to the value seen first, then the smaller one."""
    return pick_first(F.col("value"), -F.col("n"), F.col("first_ts"), F.col("value"), where=F.col("facet") == facet)


def leading_category() -> list[Column]:
    """The `LEADING` columns from the facet rows of a customer; scores are engagements over the largest one."""
    at = (F.col("facet") == "category") & (F.col("level") == 1) & (F.col("engagement") > 0)
    engaged = F.when(at, F.col("engagement"))
    return [
        F.when(F.max(engaged).isNotNull(), F.lit(1.0)).alias("top_category_score"),
        pick_first(F.col("item_purchases"), -F.col("engagement"), F.col("first_engaged"), F.col("value"), where=at).cast("double").alias("top_category_purchases"),
        (F.max(engaged) / F.sum(engaged)).alias("category_concentration"),
    ]


def customer_metrics(rollup: DataFrame, leading: bool = False) -> DataFrame:
    """Totals and modes per customer from the facet rows, with the `LEADING` columns if asked for."""
    whole = F.col("facet") == "all"

    def total(name: str) -> Column:
        return F.max(F.when(whole, F.col(name)))

    leaders = []
    for level in (1, 2, 3):
        at = (F.col("facet") == "category") & (F.col("level") == level) & (F.col("engagement") > 0)
        key = F.struct((-F.col("engagement")).alias("e"), F.col("first_engaged").alias("t"), F.col("value").alias("c"))
        # every level's leader scores exactly 1, so the earliest engaged leader is the top category
        leaders.append(F.min(F.when(at, key)).alias(f"leader_{level}"))
    grouped = rollup.groupBy("customer_id").agg(
        total("first_ts").alias("first_seen"), total("last_ts").alias("last_seen"),
        total("n").alias("total_events"),
        total("purchases").alias("total_purchases"),
        F.coalesce(total("revenue"), F.lit(0)).cast("decimal(28,2)").alias("total_revenue"),
        total("first_purchase").alias("first_purchase"), total("last_purchase").alias("last_purchase"),
        total("refunds").alias("total_refunds"), total("sessions").alias("total_sessions"),
        total("views").alias("total_page_views"), total("item_views").alias("total_items_viewed"),
        total("carts").alias("total_cart_additions"),
        ratio(total("on_mobile"), total("with_device")).alias("mobile_session_ratio"),
        _mode("weekday").cast("int").alias("preferred_day_of_week"),
        _mode("hour").cast("int").alias("preferred_hour_of_day"),
        _mode("device").alias("primary_device_type"),
        F.count_if((F.col("facet") == "category") & (F.col("engagement") > 0)).alias("category_count"),
        *leaders, *(leading_category() if leading else []),
    )
    tops = F.array(*[
        F.when(F.col(f"leader_{i}").isNotNull(), F.struct(
            F.col(f"leader_{i}.t").alias("t"), F.lit(i).alias("level"), F.col(f"leader_{i}.c").alias("c")))
        for i in (1, 2, 3)
    ])
    return grouped.withColumn("top_category", ranked_first(tops)["c"]).drop("leader_1", "leader_2", "leader_3")


def interval_stats(events: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and regularity of the days between purchases.

    Gaps only depend on the distinct purchase instants and how often each occurs,
    so equal instants are counted first. The instants of one customer are then cut
    into calendar-day buckets: gaps inside a bucket come from a window over
    (customer, day), gaps between buckets from the first and last instant per
    bucket. A customer with a third of all purchases is thereby spread over one
    task group per day. The zero gaps of repeated instants enter the variance
    analytically.
    """
    instants = (
        events.where(F.col("event_type") == "purchase")
        .groupBy("customer_id", "ts").agg(F.count("*").alias("n"))
        .withColumn("day", F.floor(F.unix_micros("ts") / F.lit(MICROS_PER_DAY)))
    )
    in_day = Window.partitionBy("customer_id", "day").orderBy("ts")
    gap = (F.unix_micros("ts") - F.unix_micros("prev")) / F.lit(float(MICROS_PER_DAY))
    days = (
        instants.withColumn("prev", F.lag("ts").over(in_day)).withColumn("gap", gap)
        .groupBy("customer_id", "day")
        .agg(
            F.min("ts").alias("day_first"), F.max("ts").alias("day_last"), F.sum("n").alias("n"),
            F.sum(F.col("n") - 1).alias("zero_gaps"),
            F.count("gap").alias("m"), F.avg("gap").alias("mean"), F.var_pop("gap").alias("var"),
            F.min("gap").alias("lo"), F.max("gap").alias("hi"),
        )
    )
    # one row per customer and active day from here on
    by_day = Window.partitionBy("customer_id").orderBy("day")
    across = (F.unix_micros("day_first") - F.unix_micros(F.lag("day_last").over(by_day))) / F.lit(float(MICROS_PER_DAY))
    linked = days.withColumn("across", across)
    moments = linked.groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.sum("zero_gaps").alias("zeros"),
        F.min("day_first").alias("first"), F.max("day_last").alias("last"),
        F.sum("m").alias("m_in"), F.coalesce(F.sum(F.col("m") * F.col("mean")), F.lit(0.0)).alias("sum_in"),
        F.sum(F.col("m") * F.col("var")).alias("within"),
        F.sum(F.col("m") * F.col("mean") * F.col("mean")).alias("sq_in"),
        F.count("across").alias("m_x"), F.coalesce(F.avg("across"), F.lit(0.0)).alias("mean_x"),
        F.coalesce(F.var_pop("across"), F.lit(0.0)).alias("var_x"),
        F.least(F.min("lo"), F.min("across")).alias("lo"), F.greatest(F.max("hi"), F.max("across")).alias("hi"),
    ).where(F.col("n") > 1)
    gaps = F.col("n") - 1
    mean_in = ratio(F.col("sum_in"), F.col("m_in"))
    # squared deviations inside days around their common mean, then merged with the other two groups
    m2_in = F.coalesce(F.col("within") + F.greatest(F.col("sq_in") - F.col("m_in") * mean_in * mean_in, F.lit(0.0)), F.lit(0.0))
    m2_x = F.col("var_x") * F.col("m_x")
    positive = F.col("m_in") + F.col("m_x")
    shift = mean_in - F.col("mean_x")
    m2_pos = m2_in + m2_x + ratio(shift * shift * F.col("m_in") * F.col("m_x"), positive)
    mean_pos = ratio(F.col("sum_in") + F.col("m_x") * F.col("mean_x"), positive)
    m2 = m2_pos + ratio(mean_pos * mean_pos * positive * F.col("zeros"), positive + F.col("zeros"))
    mean = (F.unix_micros("last") - F.unix_micros("first")) / F.lit(float(MICROS_PER_DAY)) / gaps
    std = F.when(gaps >= 2, F.sqrt(m2 / (gaps - 1)))
    staged = moments.select(
        "customer_id", mean.alias("interval_mean"), std.alias("interval_std"),
        F.when(F.col("zeros") > 0, F.lit(0.0)).otherwise(F.col("lo")).alias("interval_min"),
        F.coalesce("hi", F.lit(0.0)).alias("interval_max"),
    )
    cv = F.when(F.col("interval_mean") > 0, F.col("interval_std") / F.col("interval_mean"))
    return staged.withColumn("interval_cv", cv).withColumn(
        "regularity_index", F.when(F.col("interval_cv").isNotNull(), 1 - F.least(F.col("interval_cv") / 2, F.lit(1.0))))


def annuity(years: int, rate: float) -> float:
    """Sum of the monthly discount factors over the projection."""
    return sum((1 + rate) ** (-month / 12) for month in range(12 * years))


def behavior_type(regular_cv: float = 0.5, irregular_cv: float = 1.0, long_cycle_days: float = 90.0) -> Column:
    n, cv, mean = F.col("total_purchases"), F.col("interval_cv"), F.col("interval_mean")
    return (
        F.when(n == 0, "new").when(n == 1, "one_time")
        .when(cv.isNull() | mean.isNull(), "new")
        .when(cv <= regular_cv, "regular")
        .when((mean >= long_cycle_days) & (cv <= irregular_cv), "long_cycle")
        .otherwise("irregular")
    )


def purchase_columns(metrics: DataFrame, reference: Column) -> DataFrame:
    """Order value, refund rate, recency and monthly purchase frequency."""
    n = F.col("total_purchases")
    span = whole_days(F.col("last_purchase"), F.col("first_purchase"))
    refunds = ratio(F.col("total_refunds"), n)
    return metrics.withColumns({
        "avg_order_value": ratio(F.col("total_revenue"), n),
        "raw_refund_rate": refunds,
        "refund_rate": F.least(refunds, F.lit(1.0)),
        "days_since_last_purchase": whole_days(reference, F.col("last_purchase")),
        "purchase_frequency_per_month": F.when(n == 0, 0.0).when(span > 0, n / (span / 30.0)).otherwise(n.cast("double")),
    })


def session_columns(metrics: DataFrame) -> DataFrame:
    carts = F.col("total_cart_additions")
    rate = F.when(carts > 0, F.greatest(F.lit(0.0), 1 - ratio(F.col("total_purchases"), carts))).otherwise(0.0)
    return metrics.withColumn("cart_abandonment_rate", rate)


def value_columns(metrics: DataFrame, reference: Column, years: int = 3, rate: float = 0.1) -> DataFrame:
    """Heuristic lifetime value and churn risk."""
    tenure = whole_days(reference, F.col("first_seen"))
    freq = F.col("purchase_frequency_per_month")
    worth = F.bround(freq * F.col("avg_order_value") * F.lit(annuity(years, rate)), 2)
    recency = (
        F.when(F.col("days_since_last_purchase").isNotNull(), F.least(F.lit(1.0), F.col("days_since_last_purchase") / 180.0))
        .when(tenure > 30, 1.0).otherwise(0.5)
    )
    rare = F.when(freq <= 1.0, F.greatest(F.lit(0.0), 1 - freq)).otherwise(0.0)
    idle = F.when(F.col("total_sessions") == 0, 1.0).otherwise(0.0)
    risk = 0.4 * recency + 0.25 * rare + 0.2 * F.col("cart_abandonment_rate") + 0.15 * idle
    return metrics.withColumns({
        "clv_estimate": F.when((F.col("total_purchases") == 0) | (tenure <= 0), 0.0).otherwise(worth),
        "churn_risk_score": clamp(risk),
        "tenure_days": whole_days(F.col("last_seen"), F.col("first_seen")),
    })


def build_profiles(
    events: DataFrame, reference: Column, merge_map: DataFrame | None = None, min_events: int = 1,
    projection_years: int = 3, discount_rate: float = 0.1, leading: bool = False,
) -> DataFrame:
    """Full profile of every customer with at least `min_events` events, with the `LEADING` columns if asked for.

    `events` must already carry canonical ids when a merge map is given. The
    joined inputs are all grouped by customer, so Spark keeps one partitioning.
    """
    base = customer_metrics(facet_rows(activity_cells(events)), leading).where(F.col("total_events") >= min_events)
    wide = value_columns(session_columns(purchase_columns(base, reference)), reference, projection_years, discount_rate)
    wide = wide.join(interval_stats(events), "customer_id", "left").withColumn("behavior_type", behavior_type())
    if merge_map is not None:
        from patronlens.operators.identity import merged_id_counts

        wide = wide.join(merged_id_counts(merge_map), "customer_id", "left").withColumn(
            "merged_ids", F.coalesce("merged_ids", F.lit(0)))
    return wide


def category_affinity(events: DataFrame) -> DataFrame:
    """Long table of category engagement per customer, level and category.

    The window runs over already grouped rows: its partitions are bounded by the
    number of categories of a level, never by the number of events.
    """
    grouped = facet_rows(activity_cells(events, clock=False)).where(F.col("engagement") > 0)
    level = Window.partitionBy("customer_id", "level")
    return grouped.select(
        "customer_id", "level", F.col("value").alias("category"), "engagement",
        F.col("views").alias("view_count"), F.col("item_purchases").alias("purchase_count"), "first_engaged",
        (F.col("engagement") / F.max("engagement").over(level)).alias("engagement_score"),
    )


def ranked_affinity(affinity: DataFrame) -> DataFrame:
    """Position of each affinity in the customer's list (score, then first engaged)."""
    order = Window.partitionBy("customer_id").orderBy(F.desc("engagement_score"), "first_engaged", "level", "category")
    return affinity.withColumn("position", F.row_number().over(order))


def nested_affinity(affinity: DataFrame) -> DataFrame:
    """Affinities as one ordered array per customer, bounded by the category catalogue."""
    item = F.struct(
        (-F.col("engagement_score")).alias("order_score"), "first_engaged", "level", "category",
        "engagement_score", "view_count", "purchase_count")
    packed = affinity.groupBy("customer_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return packed.select("customer_id", F.transform("items", lambda x: F.struct(
        x["category"].alias("category"), x["engagement_score"].alias("score"), x["view_count"].alias("views"),
        x["purchase_count"].alias("purchases"), x["level"].alias("level"))).alias("category_affinities"))


def population_summary(profiles: DataFrame) -> DataFrame:
    revenue = F.col("total_revenue").cast("double")
    return profiles.agg(
        F.count("*").alias("n_customers"),
        F.sum("total_revenue").cast("double").alias("total_revenue"),
        money_avg(revenue).alias("avg_revenue_per_customer"),
        F.sum("total_purchases").alias("total_purchases"),
        F.avg("total_purchases").alias("avg_purchases_per_customer"),
        F.sum("total_sessions").alias("total_sessions"),
        F.avg("total_sessions").alias("avg_sessions_per_customer"),
        money_avg(F.col("clv_estimate")).alias("avg_clv"),
        F.avg("churn_risk_score").alias("avg_churn_risk"),
        F.avg((F.col("total_purchases") > 0).cast("double")).alias("pct_with_purchases"),
        F.avg("cart_abandonment_rate").alias("avg_cart_abandonment_rate"),
    )


def seen_until(profiles: DataFrame, cutoff: Column) -> DataFrame:
    return profiles.where(F.col("last_seen") <= cutoff)


def in_window(latest: Column, days: Column) -> Column:
    """Whether a profile is active in the `days` before the instant `latest`."""
    since = F.unix_micros(latest) - days.cast("bigint") * F.lit(MICROS_PER_DAY)
    return (F.col("first_seen") <= latest) & (F.unix_micros("last_seen") >= since)


def trailing_windows(profiles: DataFrame, days: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Profiles active in each trailing window, tagged with `window_days`.

    The reference instant is the latest activity of all profiles, a scalar subquery.
    """
    latest = profiles.agg(F.max("last_seen").alias("m")).scalar()
    tagged = profiles.withColumn("_latest", latest).withColumn("window_days", F.explode(F.array(*[F.lit(d) for d in days])))
    return tagged.where(in_window(F.col("_latest"), F.col("window_days"))).drop("_latest")
