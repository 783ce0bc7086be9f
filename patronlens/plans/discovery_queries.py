"""Registered queries: attribute discovery, trait scores and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import profiles as profiles_sql, with_
from patronlens.functions.lineage import cut
from patronlens.operators import discovery
from patronlens.plans.inputs import shop_profiles
from patronlens.plans.registry import query
from patronlens.plans.report_queries import tidy
from patronlens.sources import retail

_LONG = """
item AS (SELECT *, CASE WHEN kind = 'purchase_item' AND l_linestatus = 'O' THEN 'purchase' ELSE kind END AS etype FROM lines WHERE kind <> 'refund'),
long AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, etype, CAST(o_orderdate AS TIMESTAMP) AS ts, unnest(['brand', 'type', 'size', 'color', 'order_priority', 'shipping_state', 'line_ref']) AS path,
    unnest([p_brand, p_type, CAST(p_size AS VARCHAR), string_split(p_name, ' ')[1], o_orderpriority, CASE WHEN l_linestatus = 'F' THEN 'F' END, l_orderkey || '-' || l_linenumber]) AS value FROM item),
prof AS (SELECT path, count(*) AS occurrences, count(*) FILTER (WHERE value IS NULL) AS nulls, count(DISTINCT value) AS distinct_values,
  count(DISTINCT customer_id) FILTER (WHERE value IS NOT NULL) AS customers,
  count(*) FILTER (WHERE TRY_CAST(replace(replace(value, ',', ''), ' ', '') AS DOUBLE) IS NOT NULL) AS numeric,
  count(*) FILTER (WHERE regexp_matches(value, '[>/|]|::|\\\\')) AS hierarchical, avg(length(value)) AS avg_len FROM long GROUP BY 1),
cls AS (SELECT *, occurrences - nulls AS live, CASE WHEN occurrences = nulls THEN 'text' WHEN distinct_values / CAST(occurrences - nulls AS DOUBLE) > 0.7 THEN 'id'
  WHEN numeric / CAST(occurrences - nulls AS DOUBLE) >= 0.8 THEN 'numeric' WHEN hierarchical / CAST(occurrences - nulls AS DOUBLE) > 0.3 THEN 'hierarchical'
  WHEN avg_len > 100 THEN 'text' ELSE 'categorical' END AS field_type FROM prof),
fields AS (SELECT *, CASE WHEN live / CAST(occurrences AS DOUBLE) < 0.05 OR nulls / CAST(occurrences AS DOUBLE) > 0.95 THEN 'low_coverage' WHEN field_type IN ('id', 'text') THEN field_type
  WHEN distinct_values < 2 THEN 'too_few_values' WHEN distinct_values > 100 THEN 'id' ELSE 'usable' END AS status FROM cls),
dom AS (SELECT customer_id, path, value FROM (SELECT customer_id, path, value, row_number() OVER (PARTITION BY customer_id, path ORDER BY sum(CASE WHEN etype = 'purchase' THEN 5 ELSE 1 END) DESC, min(ts), value) AS rn
  FROM long JOIN fields USING (path) WHERE status = 'usable' AND value IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1),
vs AS (SELECT path, value, count(*) AS n, avg(CAST(total_revenue AS DOUBLE)) AS m, var_pop(CAST(total_revenue AS DOUBLE)) AS v, count(*) FILTER (WHERE churn_risk_score < 0.3) AS low,
  count(*) FILTER (WHERE churn_risk_score >= 0.3 AND churn_risk_score < 0.7) AS medium, count(*) FILTER (WHERE churn_risk_score >= 0.7) AS high FROM dom JOIN profiles USING (customer_id) GROUP BY 1, 2),
ok AS (SELECT *, sum(n * m) OVER (PARTITION BY path) / sum(n) OVER (PARTITION BY path) AS c FROM vs WHERE n >= 5),
anova AS (SELECT path, (sum(n * (m - c) * (m - c)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM ok GROUP BY 1 HAVING count(*) >= 2),
obs AS (SELECT path, value, n, unnest(['low', 'medium', 'high']) AS b, unnest([low, medium, high]) AS o FROM ok),
ex AS (SELECT *, n * sum(o) OVER (PARTITION BY path, b) / CAST(sum(o) OVER (PARTITION BY path) AS DOUBLE) AS e, sum(o) OVER (PARTITION BY path, b) AS colsum FROM obs),
chi AS (SELECT path, sum((o - e) * (o - e) / nullif(e, 0)) AS chi2, 2.0 * (count(DISTINCT value) - 1) AS dof FROM ex GROUP BY 1 HAVING min(colsum) > 0 AND count(DISTINCT value) >= 2),
pers AS (SELECT path, sum(n) AS customers, -sum(p * log2(p)) AS entropy, max(p) AS concentration,
  CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE -sum(p * log2(p)) END * CASE WHEN count(*) < 3 THEN 0.3 WHEN count(*) > 50 THEN 0.7 ELSE 1.0 END * (1 - max(p) * 0.5) AS personalization_value
  FROM (SELECT *, n / CAST(sum(n) OVER (PARTITION BY path) AS DOUBLE) AS p FROM vs) GROUP BY 1),
scores AS (SELECT f.path, f.field_type, f.distinct_values, p.entropy, p.concentration, p.personalization_value, coalesce(a.f, 0.0) AS f_statistic, least(1.0, coalesce(a.f, 0.0) / 20) AS revenue_impact,
  coalesce(c.chi2, 0.0) AS chi2_statistic, CASE WHEN c.chi2 IS NULL THEN 0.0 ELSE least(1.0, c.chi2 / c.dof / 10) END AS retention_impact, p.customers / CAST((SELECT count(*) FROM profiles) AS DOUBLE) AS customer_coverage
  FROM fields f JOIN pers p USING (path) LEFT JOIN anova a USING (path) LEFT JOIN chi c USING (path) WHERE status = 'usable' AND p.customers >= 10),
scored AS (SELECT *, 0.4 * revenue_impact + 0.3 * retention_impact + 0.3 * personalization_value AS overall_score FROM scores)
"""


# The oracle's way to the same tails: F by Simpson's rule over the beta density (t = 1 - u^2 takes its pole away), chi-squared by its Poisson terms.
_TAILS = """
tst AS (SELECT path, count(*) - 1.0 AS d1, sum(n) - count(*) AS d2 FROM ok GROUP BY 1 HAVING count(*) >= 2),
ft AS (SELECT path, CAST(d1 AS DOUBLE) AS d1, d2 / 2.0 AS a, d1 / 2.0 AS b, sqrt(d1 * f / (d2 + d1 * f)) AS u0, (1 - sqrt(d1 * f / (d2 + d1 * f))) / 20000 AS h FROM tst JOIN anova USING (path) WHERE f > 0),
fp AS (SELECT path, sum(h / 3 * w * CASE WHEN u <= 0 OR u >= 1 THEN 0 ELSE exp(ln(2) + lgamma(a + b) - lgamma(a) - lgamma(b) + (d1 - 1) * ln(u) + (a - 1) * ln(1 - u * u)) END) AS revenue_p_value
  FROM (SELECT *, u0 + i * h AS u, CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM ft, (SELECT unnest(range(0, 20001)) AS i)) GROUP BY 1),
cp AS (SELECT path, sum(exp(i * ln(chi2 / 2) - chi2 / 2 - lgamma(i + 1))) AS retention_p_value FROM (SELECT *, unnest(range(0, CAST(dof / 2 AS BIGINT))) AS i FROM chi WHERE chi2 > 0) GROUP BY 1),
sig AS (SELECT *, revenue_p_value < 0.05 OR retention_p_value < 0.05 AS is_significant FROM (
  SELECT s.*, coalesce(fp.revenue_p_value, 1.0) AS revenue_p_value, coalesce(cp.retention_p_value, 1.0) AS retention_p_value FROM scored s LEFT JOIN fp USING (path) LEFT JOIN cp USING (path)))"""


def oracle(select: str, *more: str) -> str:
    return with_(profiles_sql("shop"), _LONG, *more, select=select)


def _counts(spark, folder):
    return discovery.attribute_counts(discovery.attribute_rows(retail.shop_item_events(spark, folder)))


_FIELDS: dict = {}


def _fields(spark, folder):
    """The attribute counts and the typed fields, from one pass over the events."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FIELDS:
        counts = cut(_counts(spark, folder))
        _FIELDS[key] = counts, cut(discovery.classify(discovery.field_profile(counts)))
    return _FIELDS[key]


def _scores(spark, folder):
    counts, fields = _fields(spark, folder)
    people = shop_profiles(spark, folder)
    statistics = cut(discovery.value_statistics(discovery.dominant_values(counts, fields.where("status = 'usable'")), people))
    return fields, statistics, discovery.score_traits(fields, statistics, people.agg(F.count("*")).scalar())


_MADE: dict = {}


def _made(spark, folder):
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MADE:
        fields, statistics, scores = _scores(spark, folder)
        _MADE[key] = fields, statistics, cut(scores)
    return _MADE[key]


_ORIGIN = """
kinds AS (SELECT path, string_agg(DISTINCT etype, '|' ORDER BY etype) AS source_types FROM long GROUP BY 1),
sampled AS (SELECT path, string_agg(value, '|' ORDER BY value) AS sample_values FROM (SELECT path, arg_min(value, sha256(value)) AS value FROM long WHERE value IS NOT NULL
  GROUP BY path, (instr('0123456789abcdef', substr(sha256(value), 1, 1)) - 1) // 4) GROUP BY 1)"""


@query("attribute_profile", oracle("SELECT path, occurrences, nulls, distinct_values, customers, source_types, coalesce(sample_values, '') AS sample_values FROM prof JOIN kinds USING (path) LEFT JOIN sampled USING (path)", _ORIGIN))
def attribute_profile(spark, folder):
    found = discovery.field_profile(_counts(spark, folder))
    return found.select("path", "occurrences", "nulls", "distinct_values", "customers", *[F.array_join(c, "|").alias(c) for c in ("source_types", "sample_values")])


@query("json_attribute_profile", """
SELECT unnest(['meta', 'meta.deep', 'meta.deep.er', 'meta.deep.er.est']) AS path, count(*) AS occurrences, 0 AS distinct_values, 0 AS customers FROM events
UNION ALL
SELECT path, count(*) AS occurrences, count(DISTINCT value) AS distinct_values, count(DISTINCT user_id) AS customers FROM (
  SELECT user_id, unnest(['k', 'meta.kind', 'meta.deep.v', 'meta.deep.er.est.w', 'tags']) AS path, unnest([CAST(k AS VARCHAR), event_type, CAST(k % 3 AS VARCHAR), CAST(k % 7 AS VARCHAR), '[list:2]']) AS value
  FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1""".replace("count(DISTINCT user_id)", "CASE WHEN path = 'tags' THEN 0 ELSE count(DISTINCT user_id) END"))
def json_attribute_profile(spark, folder):
    k = F.from_json("props", "k INT")["k"]
    document = F.to_json(F.struct(
        k.alias("k"), F.struct(F.col("event_type").alias("kind"), F.struct((k % 3).alias("v"), F.struct(F.struct((k % 7).alias("w")).alias("est")).alias("er"), F.lit("y").alias("Session_ID")).alias("deep")).alias("meta"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("x").alias("visit_id")))
    log = retail.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("customer_id"), F.lit("view_item").alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"), document.alias("document"))
    return discovery.field_profile(discovery.attribute_counts(discovery.json_attribute_rows(log, "document"))).select("path", "occurrences", "distinct_values", "customers")


@query("attribute_types", oracle("SELECT path, field_type, status, round(live / CAST(occurrences AS DOUBLE), 6) AS coverage FROM fields"))
def attribute_types(spark, folder):
    return tidy(_made(spark, folder)[0].select("path", "field_type", "status", "coverage"))


@query("dominant_attribute_values", oracle("SELECT customer_id, path, value FROM dom"))
def dominant_attribute_values(spark, folder):
    counts, fields = _fields(spark, folder)
    return discovery.dominant_values(counts, fields.where("status = 'usable'"))


@query("attribute_value_statistics", oracle("SELECT path, value, n, round(m, 4) AS mean, low, medium, high FROM vs"))
def attribute_value_statistics(spark, folder):
    return tidy(_made(spark, folder)[1].select("path", "value", "n", F.round("mean", 4).alias("mean"), "low", "medium", "high"))


@query("trait_revenue_impact", oracle("SELECT path, round(f, 6) AS f_statistic, round(least(1.0, f / 20), 6) AS revenue_impact FROM anova"))
def trait_revenue_impact(spark, folder):
    return tidy(discovery.revenue_impact(_made(spark, folder)[1]).select("path", "f_statistic", "revenue_impact"))


# Other churn cuts than the default ones, so that all three buckets are filled.
_CUTS = (0.5, 0.6)
_CUT_ORACLE = oracle("SELECT path, round(chi2, 6) AS chi2_statistic, round(least(1.0, chi2 / dof / 10), 6) AS retention_impact, round(coalesce(retention_p_value, 1.0), 6) AS retention_p_value FROM chi LEFT JOIN cp USING (path)", _TAILS).replace(
    "churn_risk_score < 0.3) AS low", "churn_risk_score < 0.5) AS low").replace(
    "churn_risk_score >= 0.3 AND churn_risk_score < 0.7) AS medium", "churn_risk_score >= 0.5 AND churn_risk_score < 0.6) AS medium").replace(
    "churn_risk_score >= 0.7) AS high", "churn_risk_score >= 0.6) AS high")


@query("trait_retention_impact", _CUT_ORACLE)
def trait_retention_impact(spark, folder):
    owned = discovery.dominant_values(_counts(spark, folder), _made(spark, folder)[0].where("status = 'usable'"))
    statistics = cut(discovery.value_statistics(owned, shop_profiles(spark, folder), _CUTS))
    return tidy(discovery.retention_impact(statistics).select("path", "chi2_statistic", "retention_impact", "retention_p_value"))


@query("trait_p_values", oracle("SELECT path, round(revenue_p_value, 6) AS revenue_p_value, round(retention_p_value, 6) AS retention_p_value, is_significant FROM sig", _TAILS))
def trait_p_values(spark, folder):
    return tidy(_made(spark, folder)[2].select("path", "revenue_p_value", "retention_p_value", "is_significant"))


@query("trait_personalization", oracle("SELECT path, round(entropy, 6) AS entropy, round(concentration, 6) AS concentration, round(personalization_value, 6) AS personalization_value FROM pers"))
def trait_personalization(spark, folder):
    return tidy(discovery.personalization(_made(spark, folder)[1]).select("path", "entropy", "concentration", "personalization_value"))


@query("trait_scores", oracle("""SELECT path, field_type, distinct_values, round(customer_coverage, 6) AS customer_coverage, round(revenue_impact, 6) AS revenue_impact,
  round(retention_impact, 6) AS retention_impact, round(personalization_value, 6) AS personalization_value, round(overall_score, 6) AS overall_score FROM scored"""))
def trait_scores(spark, folder):
    return tidy(_made(spark, folder)[2].select("path", "field_type", "distinct_values", "customer_coverage", "revenue_impact", "retention_impact",
                                               "personalization_value", "overall_score"))


@query("top_revenue_values", oracle("""SELECT path, value, round(m, 4) AS measure, position FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY m DESC, value) AS position,
  count(*) OVER (PARTITION BY path) AS k FROM ok) WHERE position <= 5 AND k >= 2"""))
def top_revenue_values(spark, folder):
    return tidy(discovery.top_values(_made(spark, folder)[1]).withColumn("measure", F.round("measure", 4)))


@query("top_retention_values", oracle("""SELECT path, value, round(measure, 6) AS measure, position FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY measure DESC, value) AS position
  FROM (SELECT *, 1 - high / CAST(n AS DOUBLE) AS measure, count(*) OVER (PARTITION BY path) AS k FROM ok)) WHERE position <= 5 AND k >= 2"""))
def top_retention_values(spark, folder):
    return tidy(discovery.top_values(_made(spark, folder)[1], "retention"))


@query("top_personalization_traits", oracle("SELECT path, round(personalization_value, 6) AS personalization_value FROM scored ORDER BY scored.personalization_value DESC, path LIMIT 5"))
def top_personalization_traits(spark, folder):
    return tidy(discovery.top_traits(_made(spark, folder)[2], "personalization").select("path", "personalization_value"))


@query("top_revenue_traits", oracle("""SELECT * FROM (SELECT 'revenue' AS "by", path, round(revenue_impact, 6) AS revenue_impact FROM sig WHERE revenue_p_value < 0.1 ORDER BY sig.revenue_impact DESC, path LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'retention', path, round(retention_impact, 6) FROM sig WHERE retention_p_value < 0.1 ORDER BY sig.retention_impact DESC, path LIMIT 5)""", _TAILS))
def top_revenue_traits(spark, folder):
    scores = tidy(_made(spark, folder)[2].select("path", "revenue_p_value", "retention_p_value", "revenue_impact", "retention_impact"))
    return discovery.top_traits(scores).select(F.lit("revenue").alias("by"), "path", "revenue_impact").unionByName(
        discovery.top_traits(scores, "retention").select(F.lit("retention").alias("by"), "path", F.col("retention_impact").alias("revenue_impact")))


@query("discovery_summary", oracle("""SELECT (SELECT count(*) FROM fields) AS fields_discovered, (SELECT count(*) FROM fields WHERE status <> 'usable') AS fields_filtered_out,
  count(*) AS traits_scored, count(*) FILTER (WHERE is_significant) AS significant_traits FROM sig""", _TAILS))
def discovery_summary(spark, folder):
    fields, _, scores = _made(spark, folder)
    return discovery.discovery_summary(fields, scores)


@query("trait_actionability", oracle("""SELECT path, CASE WHEN regexp_matches(path, 'payment|shipping|order_id|purchase_id|transaction|checkout|invoice|receipt|confirmation') THEN 'not_actionable'
  WHEN regexp_matches(path, 'category|brand|color|size|device|channel|location|language|country|state|region|style|material|price_range|margin') THEN 'actionable' ELSE 'potentially_actionable' END AS actionability FROM scored"""))
def trait_actionability(spark, folder):
    _, statistics, scores = _made(spark, folder)
    return discovery.explain(scores, statistics).select("path", "actionability")


_EXPLAINED = """
ends AS (SELECT path, arg_min(value, p) AS best, arg_max(value, p) AS low FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY m DESC, value) AS p, count(*) OVER (PARTITION BY path) AS k FROM ok) WHERE p <= 5 AND k >= 2 GROUP BY 1),
risky AS (SELECT path, arg_max(value, p) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY 1 - high / CAST(n AS DOUBLE) DESC, value) AS p, count(*) OVER (PARTITION BY path) AS k FROM ok) WHERE p <= 5 AND k >= 2 GROUP BY 1),
expl AS (SELECT s.*, best, low, risk, regexp_matches(path, 'payment|shipping|order_id|purchase_id|transaction|checkout|invoice|receipt|confirmation') AS outcome,
  regexp_matches(path, 'category|brand|color|size|device|channel|location|language|country|state|region|style|material|price_range|margin') AS preference,
  CASE WHEN customer_coverage >= 0.5 THEN 2 WHEN customer_coverage >= 0.2 THEN 1 ELSE 0 END + CASE WHEN least(revenue_p_value, retention_p_value) < 0.01 THEN 2 WHEN least(revenue_p_value, retention_p_value) < 0.05 THEN 1 ELSE 0 END AS points
  FROM sig s LEFT JOIN ends USING (path) LEFT JOIN risky USING (path)),
acts AS (SELECT *, list_filter([CASE WHEN revenue_impact >= 0.5 AND revenue_p_value < 0.05 THEN 'create_high_value_segment:' || best END,
  CASE WHEN revenue_impact >= 0.5 AND revenue_p_value < 0.05 AND low <> best THEN 'investigate_low_values:' || low END,
  CASE WHEN retention_impact >= 0.5 AND retention_p_value < 0.05 THEN 'target_retention:' || risk END, CASE WHEN personalization_value >= 0.6 THEN 'personalize_content' END], lambda x: x IS NOT NULL) AS act FROM expl)"""


@query("trait_explanations", oracle("""SELECT path, CASE WHEN outcome THEN 'not_actionable' WHEN preference THEN 'actionable' ELSE 'potentially_actionable' END AS actionability,
  CASE WHEN points >= 3 THEN 'high' WHEN points >= 1 THEN 'medium' ELSE 'low' END AS confidence,
  array_to_string(list_filter([CASE WHEN revenue_p_value >= 0.05 AND revenue_impact > 0.3 THEN 'revenue_not_significant' END, CASE WHEN retention_p_value >= 0.05 AND retention_impact > 0.3 THEN 'retention_not_significant' END,
    CASE WHEN customer_coverage < 0.2 THEN 'low_coverage' END, CASE WHEN concentration > 0.9 THEN 'high_concentration' END, CASE WHEN outcome THEN 'likely_outcome' END], lambda x: x IS NOT NULL), '|') AS caveats,
  CASE WHEN outcome THEN 'descriptive_only' WHEN len(act) > 0 THEN array_to_string(act, '|') ELSE 'monitor' END AS actions FROM acts""", _TAILS, _EXPLAINED))
def trait_explanations(spark, folder):
    _, statistics, scores = _made(spark, folder)
    return discovery.explain(scores, statistics).select("path", "actionability", "confidence", F.array_join("caveats", "|").alias("caveats"),
                                                        F.array_join("actions", "|").alias("actions"))


@query("trait_heatmap", oracle("""SELECT path, round(revenue_impact, 6) AS revenue, round(retention_impact, 6) AS retention, round(personalization_value, 6) AS personalization,
  round(customer_coverage * 100, 6) AS coverage FROM scored ORDER BY overall_score DESC, path LIMIT 10"""))
def trait_heatmap(spark, folder):
    top = _made(spark, folder)[2].orderBy(F.desc("overall_score"), "path").limit(10)
    return tidy(top.select("path", F.col("revenue_impact").alias("revenue"), F.col("retention_impact").alias("retention"),
                           F.col("personalization_value").alias("personalization"), (F.col("customer_coverage") * 100).alias("coverage")))


# Trait names given to the document sources in the feedback rows.
_NAMES = ("payment_method", "shipping_speed", "order_size", "category_depth", "brand", "device_kind", "size", "mood")
_FEEDBACK = f"""
fb AS (SELECT {"[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"}[CAST(substr(source, 4) AS INTEGER) % {len(_NAMES)} + 1] AS trait_name,
  CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 THEN 'useful' WHEN doc_id % 3 = 0 THEN 'needs_context' ELSE 'not_useful' END AS feedback_type FROM labels JOIN documents USING (doc_id)),
adj AS (SELECT trait_name, count(*) AS n, greatest(0.2, least(1.5, 1.0 - 0.1 * count(*) FILTER (WHERE feedback_type IN ('not_useful', 'obvious', 'incorrect')) + 0.05 * count(*) FILTER (WHERE feedback_type = 'useful'))) AS adjustment FROM fb GROUP BY 1),
pat AS (SELECT pattern, count(*) AS sample_size, greatest(0.2, least(1.5, 1.0 - 0.1 * count(*) FILTER (WHERE feedback_type IN ('not_useful', 'obvious', 'incorrect')) + 0.05 * count(*) FILTER (WHERE feedback_type = 'useful'))) AS adjustment
  FROM (SELECT *, CASE WHEN trait_name LIKE '%payment%' THEN 'payment' WHEN trait_name LIKE '%shipping%' THEN 'shipping' WHEN trait_name LIKE '%order%' THEN 'order' WHEN trait_name LIKE '%category%' THEN 'category'
    WHEN trait_name LIKE '%brand%' THEN 'brand' WHEN trait_name LIKE '%device%' THEN 'device' END AS pattern FROM fb) WHERE pattern IS NOT NULL GROUP BY 1),
learned AS (SELECT * FROM pat WHERE sample_size >= 3 AND abs(adjustment - 1) >= 0.15)
"""


def _feedback(spark, folder):
    names = F.array(*[F.lit(n) for n in _NAMES])
    joined = retail.table(spark, folder, "labels").join(retail.table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return joined.select(
        F.element_at(names, (F.substring("source", 4, 9).cast("int") % len(_NAMES)) + 1).alias("trait_name"),
        F.when(F.col("toxic") == 1, "incorrect").when(F.col("quality") == 1, "useful").when(F.col("doc_id") % 3 == 0, "needs_context")
        .otherwise("not_useful").alias("feedback_type"))


@query("feedback_adjustments", with_(_FEEDBACK, select="SELECT trait_name, n, round(CAST(adjustment AS DOUBLE), 6) AS adjustment FROM adj"))
def feedback_adjustments(spark, folder):
    return tidy(discovery.feedback_adjustments(_feedback(spark, folder)))


@query("learned_patterns", with_(_FEEDBACK, select="SELECT pattern, sample_size, round(CAST(adjustment AS DOUBLE), 6) AS adjustment FROM learned"))
def learned_patterns(spark, folder):
    return tidy(discovery.learned_patterns(_feedback(spark, folder)))


@query("feedback_summary", with_(_FEEDBACK, select="SELECT feedback_type, count(*) AS n, count(DISTINCT trait_name) AS traits FROM fb GROUP BY 1"))
def feedback_summary(spark, folder):
    return discovery.feedback_summary(_feedback(spark, folder))


@query("adjusted_trait_scores", oracle("""SELECT s.path, round(CAST(coalesce(a.adjustment, l.adjustment, 1.0) AS DOUBLE), 6) AS feedback_adjustment, round(overall_score * CAST(coalesce(a.adjustment, l.adjustment, 1.0) AS DOUBLE), 6) AS adjusted_score
FROM scored s LEFT JOIN adj a ON a.trait_name = s.path LEFT JOIN learned l ON l.pattern = CASE WHEN s.path LIKE '%shipping%' THEN 'shipping' WHEN s.path LIKE '%order%' THEN 'order' WHEN s.path LIKE '%brand%' THEN 'brand' END""", _FEEDBACK))
def adjusted_trait_scores(spark, folder):
    return tidy(discovery.apply_feedback(_made(spark, folder)[2], _feedback(spark, folder)).select("path", "feedback_adjustment", "adjusted_score"))
