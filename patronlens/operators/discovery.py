"""Attribute discovery: which event attributes explain revenue, churn and variety."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import numeric_text
from patronlens.functions.joins import placed
from patronlens.functions.lineage import cut
from patronlens.functions.tails import chi2_p_value, f_p_value

# Event types that carry product attributes.
PRODUCT_EVENTS = ("purchase", "purchase_item", "add_to_cart", "view_item", "checkout")
# Names of system fields, which are never attributes.
SYSTEM_FIELDS = (r"^__", r"_timestamp$", r"_id$", r"^session_id$", r"^event_id$", r"^customer_id$", r"^internal_customer_id$")
# Name parts of outcomes of a purchase, and of preferences.
OUTCOME_WORDS = ("payment", "shipping", "order_id", "purchase_id", "transaction", "checkout", "invoice", "receipt", "confirmation")
PREFERENCE_WORDS = ("category", "brand", "color", "size", "device", "channel", "location", "language", "country", "state", "region",
                    "style", "material", "price_range", "margin")
# Name prefixes for which feedback is pooled.
FEEDBACK_PREFIXES = ("payment", "shipping", "order", "category", "brand", "device")
NEGATIVE_FEEDBACK = ("not_useful", "obvious", "incorrect")

#: Stands for an object, whose own paths hold its values.
OBJECT = "[object]"
#: Values kept of each path, at most one for each part of the range of a hash.
SAMPLES = 4


@dataclass(frozen=True)
class Limits:
    min_coverage: float = 0.05
    max_cardinality: int = 100
    min_cardinality: int = 2
    max_missing: float = 0.95
    numeric_share: float = 0.8
    hierarchy_share: float = 0.3
    id_uniqueness: float = 0.7
    text_length: float = 100.0
    min_customers: int = 5


def _leaf(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def _not_system(path: Column) -> Column:
    return ~_leaf(path).rlike("(?i)" + "|".join(SYSTEM_FIELDS))


def attribute_rows(events: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Product events as rows (event_id, customer_id, event_type, ts, path, value) from a text map.

    The events are placed by customer while their attributes are still folded.
    """
    rows = events.where(F.col("event_type").isin(*PRODUCT_EVENTS)).select("event_id", "customer_id", "event_type", "ts", F.col(attributes).alias("_own"))
    named = placed(rows, "customer_id").select("event_id", "customer_id", "event_type", "ts", F.explode("_own").alias("path", "value"))
    return named.where(_not_system(F.col("path")))


def json_attribute_rows(events: DataFrame, document: str) -> DataFrame:
    """The same rows from JSON text: objects are opened level by level until none is left; lists only leave their length.

    An object is a path of its own, with the value OBJECT, and so are the paths inside it.
    """
    keep = ["event_id", "customer_id", "event_type", "ts"]
    open_rows = events.where(F.col("event_type").isin(*PRODUCT_EVENTS)).select(
        *keep, F.lit("").alias("prefix"), F.try_parse_json(document).alias("v"))
    done = None
    while True:
        opened = open_rows.select(*keep, "prefix", F.col("v")).lateralJoin(
            events.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select("key", "value"))
        named = opened.where(F.col("key").isNotNull()).select(
            *keep, F.concat("prefix", "key").alias("path"), F.col("value").alias("v")).where(_not_system(F.col("path")))
        kind = F.schema_of_variant("v")
        level = cut(named.select(*keep, "path", kind.startswith("OBJECT").alias("nested"), F.when(kind.startswith("OBJECT"), F.to_json("v")).when(
            kind.startswith("ARRAY"), F.concat(F.lit("[list:"), F.json_array_length(F.to_json("v")).cast("string"), F.lit("]"))
        ).otherwise(F.try_variant_get("v", "$", "string")).alias("value")))
        leaves = level.select(*keep, "path", F.when(F.col("nested"), OBJECT).otherwise(F.col("value")).alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        deeper = level.where("nested")
        if deeper.isEmpty():
            return done
        open_rows = deeper.select(*keep, F.concat("path", F.lit(".")).alias("prefix"), F.try_parse_json("value").alias("v"))


def attribute_counts(rows: DataFrame) -> DataFrame:
    """Rows folded to (customer, path, value) with occurrences, weight and first time.

    This is the only pass over the events: the field profile and the dominant
    values both start from it. A purchase weighs five. `kinds` has a bit for each event type.
    """
    weight = F.when(F.col("event_type") == "purchase", 5).otherwise(1)
    kind = F
    for i, name in enumerate(PRODUCT_EVENTS):
        kind = kind.when(F.col("event_type") == name, 1 << i)
    return rows.groupBy("customer_id", "path", "value").agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"), F.min("ts").alias("first_ts"), F.bit_or(kind.otherwise(0)).alias("kinds"))


def field_profile(counts: DataFrame) -> DataFrame:
    """Occurrences, nulls, distinct values, customers, value shapes, event types and sample values of every path.

    Values are counted per (path, value) first. A path seen in every event is
    thereby spread over its values, and the second step only folds counts. The
    samples are the values of smallest hash in each quarter of the hash range:
    the same on every run, and merged like any minimum.
    """
    value = F.col("value")
    values = counts.groupBy("path", "value").agg(F.sum("n").alias("n"), F.bit_or("kinds").alias("kinds"))
    live, listed, opened = value.isNotNull(), value.startswith("[list:"), value == OBJECT
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    # a path's values meet in the order of a sort, which small parts keep in memory
    hashed = placed(values, "path", "value").withColumn("_hash", F.when(live & ~opened, F.sha2("value", 256)))
    quarter = F.floor((F.instr(F.lit("0123456789abcdef"), F.substring("_hash", 1, 1)) - 1) / 4)
    samples = F.array(*[F.min(F.when(quarter == i, F.struct("_hash", "value"))) for i in range(SAMPLES)])
    seen = F.bit_or("kinds")
    shaped = hashed.groupBy("path").agg(
        F.sum("n").alias("occurrences"), total(~live).alias("nulls"), F.count_if(live & ~opened).alias("distinct_values"),
        total(listed).alias("lists"), total(opened).alias("objects"), total(numeric_text(value)).alias("numeric"),
        total(value.rlike(r"[>/|\\]|::")).alias("hierarchical"), F.coalesce(F.sum(F.when(~opened, F.length("value") * F.col("n"))), F.lit(0)).alias("characters"),
        F.array_sort(F.array_compact(F.array(*[F.when(seen.bitwiseAND(1 << i) > 0, name) for i, name in enumerate(PRODUCT_EVENTS)]))).alias("source_types"),
        F.array_sort(F.transform(F.array_compact(samples), lambda v: v["value"])).alias("sample_values"))
    people = counts.where(live & ~listed & ~opened).select("path", "customer_id").distinct().groupBy("path").agg(F.count("*").alias("customers"))
    return shaped.join(people, "path", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


def classify(profile: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Type of every path and whether it is usable as a trait, with the reason when not."""
    c = F.col
    live = c("occurrences") - c("nulls")
    share = lambda name: F.try_divide(c(name).cast("double"), live.cast("double"))
    typed = profile.withColumns({
        "coverage": live / c("occurrences"), "uniqueness": F.coalesce(F.try_divide(c("distinct_values").cast("double"), live.cast("double")), F.lit(0.0)),
    })
    kind = (
        F.when((live == 0) | (c("distinct_values") == 0), "text").when(c("lists") > 0, "list").when(c("uniqueness") > limits.id_uniqueness, "id")
        .when(share("numeric") >= limits.numeric_share, "numeric").when(share("hierarchical") > limits.hierarchy_share, "hierarchical")
        .when(share("characters") > limits.text_length, "text").otherwise("categorical"))
    typed = typed.withColumn("field_type", kind)
    missing = c("nulls") / c("occurrences")
    status = (
        F.when((c("coverage") < limits.min_coverage) | (missing > limits.max_missing), "low_coverage")
        .when(c("field_type").isin("id", "text", "list"), c("field_type"))
        .when(c("distinct_values") < limits.min_cardinality, "too_few_values")
        .when(c("distinct_values") > limits.max_cardinality, "id").otherwise("usable"))
    return typed.withColumn("status", status)


def dominant_values(counts: DataFrame, usable: DataFrame) -> DataFrame:
    """Value with the most weight per customer and path.

    The usable paths, some names at most, arrive as one scalar array: a join would deal all
    rows by path, and a path has a row for nearly every customer.
    """
    paths = usable.agg(F.collect_set("path")).scalar()
    kept = counts.where(F.col("value").isNotNull() & F.array_contains(paths, F.col("path")))
    return kept.groupBy("customer_id", "path").agg(
        F.min_by("value", F.struct((-F.col("w")).alias("w"), "first_ts", "value")).alias("value"))


def value_statistics(traits: DataFrame, profiles: DataFrame, cuts: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Per path and value: owners, revenue moments and churn buckets, from one join for all paths."""
    people = profiles.select("customer_id", F.col("total_revenue").cast("double").alias("revenue"), "churn_risk_score")
    risk = F.col("churn_risk_score")
    return traits.join(people, "customer_id", "left").groupBy("path", "value").agg(
        F.count("*").alias("owners"), F.count("revenue").alias("n"), F.avg("revenue").alias("mean"), F.var_pop("revenue").alias("var"),
        F.count_if(risk < cuts[0]).alias("low"), F.count_if((risk >= cuts[0]) & (risk < cuts[1])).alias("medium"),
        F.count_if(risk >= cuts[1]).alias("high"))


def revenue_impact(statistics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One-way analysis of variance of revenue over the values of each path, from moments."""
    valid = statistics.where(F.col("n") >= limits.min_customers)
    path = Window.partitionBy("path")  # at most max_cardinality rows
    centre = F.sum(F.col("n") * F.col("mean")).over(path) / F.sum("n").over(path)
    sums = valid.withColumn("centre", centre).groupBy("path").agg(
        F.count("*").alias("k"), F.sum("n").alias("total"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"),
    ).where(F.col("k") >= 2)
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    f = F.when((F.col("within") == 0) & (F.col("between") > 0), F.lit(float("inf"))).when(
        F.col("within") > 0, (F.col("between") / d1) / (F.col("within") / d2))
    return sums.select("path", f.alias("f_statistic"), d1.alias("d1"), d2.alias("d2")).select(
        "path", "f_statistic", f_p_value("f_statistic", "d1", "d2").alias("revenue_p_value"),
        F.when(F.col("f_statistic").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("f_statistic") / 20.0)).alias("revenue_impact"))


def retention_impact(statistics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chi-squared test of value against churn bucket; an empty bucket means no test."""
    valid = statistics.where(F.col("n") >= limits.min_customers)
    path = Window.partitionBy("path")
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).cast("double").alias("seen")) for b in ("low", "medium", "high")])
    cells = valid.select("path", "value", F.col("n").cast("double").alias("row_n"), F.inline(buckets))
    cells = cells.withColumns({
        "column_n": F.sum("seen").over(Window.partitionBy("path", "bucket")), "total": F.sum("seen").over(path)})
    expected = F.col("row_n") * F.col("column_n") / F.col("total")
    tests = cells.groupBy("path").agg(
        F.sum(F.try_divide(F.pow(F.col("seen") - expected, 2), expected)).alias("chi2"), F.count_distinct("value").alias("k"),
        F.min("column_n").alias("smallest")).where((F.col("k") >= 2) & (F.col("smallest") > 0))
    dof = (2 * (F.col("k") - 1)).cast("double")
    return tests.select("path", "chi2", dof.alias("dof")).select(
        "path", F.col("chi2").alias("chi2_statistic"), chi2_p_value("chi2", "dof").alias("retention_p_value"),
        F.least(F.lit(1.0), F.col("chi2") / F.col("dof") / 10.0).alias("retention_impact"))


def personalization(statistics: DataFrame) -> DataFrame:
    """Normalised entropy, damped for few or many values and for concentration."""
    share = F.col("owners") / F.sum("owners").over(Window.partitionBy("path"))
    sums = statistics.withColumn("p", share).groupBy("path").agg(
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("k"), F.max("p").alias("concentration"), F.sum("owners").alias("customers"))
    normal = F.when(F.col("k") > 1, F.col("entropy") / F.log2(F.col("k").cast("double"))).otherwise(F.col("entropy"))
    factor = F.when(F.col("k") < 3, 0.3).when(F.col("k") > 50, 0.7).otherwise(1.0)
    return sums.select("path", "entropy", "concentration", F.col("customers").alias("trait_customers"),
                       (normal * factor * (1 - 0.5 * F.col("concentration"))).alias("personalization_value"))


def score_traits(fields: DataFrame, statistics: DataFrame, total_customers: Column, limits: Limits = Limits()) -> DataFrame:
    """All scores of the usable paths with enough customers, ready for ranking."""
    kept = personalization(statistics).where(F.col("trait_customers") >= 2 * limits.min_customers)
    joined = fields.where(F.col("status") == "usable").select("path", "field_type", "distinct_values").join(kept, "path")
    joined = joined.join(revenue_impact(statistics, limits), "path", "left").join(retention_impact(statistics, limits), "path", "left")
    filled = joined.withColumns({
        **{n: F.coalesce(n, F.lit(0.0)) for n in ("revenue_impact", "retention_impact", "f_statistic", "chi2_statistic")},
        **{n: F.coalesce(n, F.lit(1.0)) for n in ("revenue_p_value", "retention_p_value")},
        "customer_coverage": F.col("trait_customers") / F.greatest(total_customers, F.lit(1)).cast("double"),
        "trait_name": _leaf(F.col("path")),
    })
    c = F.col
    return filled.withColumns({
        "overall_score": 0.4 * c("revenue_impact") + 0.3 * c("retention_impact") + 0.3 * c("personalization_value"),
        "is_significant": (c("revenue_p_value") < 0.05) | (c("retention_p_value") < 0.05),
        "recommended_uses": F.array_compact(F.array(
            F.when((c("revenue_impact") >= 0.5) & (c("revenue_p_value") < 0.05), "segmentation"),
            F.when((c("retention_impact") >= 0.5) & (c("retention_p_value") < 0.05), "retention_targeting"),
            F.when(c("personalization_value") >= 0.6, "personalization"),
            F.when((c("distinct_values") >= 3) & (c("concentration") < 0.7), "content_customization"))),
    })


def top_values(statistics: DataFrame, by: str = "revenue", n: int = 5, limits: Limits = Limits()) -> DataFrame:
    """Best values per path by average revenue or by share without high churn risk (a top-k report)."""
    measure = F.col("mean") if by == "revenue" else 1 - F.col("high") / F.col("n")
    valid = statistics.where(F.col("n") >= limits.min_customers).withColumn("measure", measure)
    order = Window.partitionBy("path").orderBy(F.desc("measure"), "value")
    enough = F.count("*").over(Window.partitionBy("path")) >= 2
    return valid.withColumn("enough", enough).where("enough").withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= n).select("path", "value", "measure", "position")


def top_traits(scores: DataFrame, by: str = "revenue", n: int = 5) -> DataFrame:
    """Leading traits by revenue or retention impact (p < 0.1) or by personalisation value."""
    if by == "personalization":
        return scores.orderBy(F.desc("personalization_value"), "path").limit(n)
    return scores.where(F.col(f"{by}_p_value") < 0.1).orderBy(F.desc(f"{by}_impact"), "path").limit(n)


def discovery_summary(fields: DataFrame, scores: DataFrame) -> DataFrame:
    found = fields.agg(F.count("*").alias("fields_discovered"), F.count_if(F.col("status") != "usable").alias("fields_filtered_out"))
    return scores.agg(F.count("*").alias("traits_scored"), F.count_if("is_significant").alias("significant_traits")).withColumn(
        "f", found.select(F.struct("*")).scalar()).select("f.*", "traits_scored", "significant_traits")


def leading_values(statistics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, best_value, low_value, risky_value): first and last of the leading values by revenue, last by retention."""
    ends = None
    for by, first, last in (("revenue", "best_value", "low_value"), ("retention", None, "risky_value")):
        top = top_values(statistics, by, limits=limits).groupBy("path").agg(
            *([F.min_by("value", "position").alias(first)] if first else []), F.max_by("value", "position").alias(last))
        ends = top if ends is None else ends.join(top, "path", "full")
    return ends


def explain(scores: DataFrame, statistics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Actionability class, caveat codes, confidence and action codes of every trait, with the values the actions are about."""
    c = F.col
    scores = scores.join(leading_values(statistics, limits), "path", "left")
    names = F.concat_ws("\n", F.lower("trait_name"), F.lower("path"))
    outcome, preference = names.rlike("|".join(OUTCOME_WORDS)), names.rlike("|".join(PREFERENCE_WORDS))
    strong = (c("revenue_impact") >= 0.5) & (c("revenue_p_value") < 0.05)
    sticky = (c("retention_impact") >= 0.5) & (c("retention_p_value") < 0.05)
    varied = c("personalization_value") >= 0.6
    lowest = F.least("revenue_p_value", "retention_p_value")
    points = F.when(c("customer_coverage") >= 0.5, 2).when(c("customer_coverage") >= 0.2, 1).otherwise(0) + F.when(
        lowest < 0.01, 2).when(lowest < 0.05, 1).otherwise(0)
    actions = F.array_compact(F.array(
        F.when(strong & c("best_value").isNotNull(), F.concat(F.lit("create_high_value_segment:"), c("best_value"))),
        F.when(strong & (c("low_value") != c("best_value")), F.concat(F.lit("investigate_low_values:"), c("low_value"))),
        F.when(sticky & c("risky_value").isNotNull(), F.concat(F.lit("target_retention:"), c("risky_value"))),
        F.when(varied, "personalize_content")))
    return scores.withColumns({
        "actionability": F.when(outcome, "not_actionable").when(preference, "actionable").otherwise("potentially_actionable"),
        "caveats": F.array_compact(F.array(
            F.when((c("revenue_p_value") >= 0.05) & (c("revenue_impact") > 0.3), "revenue_not_significant"),
            F.when((c("retention_p_value") >= 0.05) & (c("retention_impact") > 0.3), "retention_not_significant"),
            F.when(c("customer_coverage") < 0.2, "low_coverage"), F.when(c("concentration") > 0.9, "high_concentration"),
            F.when(F.lower("trait_name").rlike("|".join(OUTCOME_WORDS)), "likely_outcome"))),
        "confidence": F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low"),
        "actions": F.when(outcome, F.array(F.lit("descriptive_only"))).when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("monitor"))),
    })


def _adjustment() -> Column:
    useful, bad = F.count_if(F.col("feedback_type") == "useful"), F.count_if(F.col("feedback_type").isin(*NEGATIVE_FEEDBACK))
    return F.greatest(F.lit(0.2), F.least(F.lit(1.5), 1.0 - 0.1 * bad + 0.05 * useful))


def feedback_adjustments(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("trait_name").agg(F.count("*").alias("n"), _adjustment().alias("adjustment"))


def feedback_prefix(name: Column) -> Column:
    """First prefix, in list order, that occurs in the name."""
    out = F
    for prefix in FEEDBACK_PREFIXES:
        out = out.when(F.contains(F.lower(name), F.lit(prefix)), prefix)
    return out


def learned_patterns(feedback: DataFrame, min_samples: int = 3, min_shift: float = 0.15) -> DataFrame:
    """Prefixes whose pooled feedback is large and clear enough."""
    pooled = feedback.withColumn("pattern", feedback_prefix(F.col("trait_name"))).where(F.col("pattern").isNotNull())
    learned = pooled.groupBy("pattern").agg(F.count("*").alias("sample_size"), _adjustment().alias("adjustment"))
    return learned.where((F.col("sample_size") >= min_samples) & (F.abs(F.col("adjustment") - 1.0) >= min_shift - 1e-12))


def apply_feedback(scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """Own feedback first, else the first learned pattern found in the name, else no change.

    There are at most six patterns, so they arrive as one scalar array.
    """
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(FEEDBACK_PREFIXES) for x in (p, i)])
    patterns = learned_patterns(feedback).agg(F.array_sort(F.collect_list(F.struct(
        rank[F.col("pattern")].alias("rank"), "pattern", "adjustment")))).scalar()
    own = feedback_adjustments(feedback).select("trait_name", F.col("adjustment").alias("own"))
    joined = scores.join(own, "trait_name", "left").withColumn("_patterns", patterns)
    matching = F.filter("_patterns", lambda p: F.contains(F.lower("trait_name"), p["pattern"]))
    learned = F.try_element_at(matching, F.lit(1))["adjustment"]
    return joined.withColumn("feedback_adjustment", F.coalesce("own", learned, F.lit(1.0))).withColumn(
        "adjusted_score", F.col("overall_score") * F.col("feedback_adjustment")).drop("own", "_patterns")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_type").agg(F.count("*").alias("n"), F.count_distinct("trait_name").alias("traits"))
