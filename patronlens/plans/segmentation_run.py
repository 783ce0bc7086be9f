"""The whole analysis from events to prioritised segments, as one chain of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.functions.lineage import cut
from patronlens.operators import clustering, identity, profiles, scoring, stability, whitespace


def run(
    events: DataFrame, history: DataFrame, reference: Column, k: int | None = None, k_range: Sequence[int] = range(3, 11), seed: int = 42,
    restarts: int = 10, include_sampling: bool = False, strict_order: bool = False, predictions: DataFrame | None = None, lenient_merges: bool = False,
) -> dict[str, DataFrame]:
    """Profiles, members, segments, robustness, whitespace and prioritised segments.

    Dimensions are evaluated before validation, so that a segment is not rejected
    for lacking what was never computed; `strict_order` validates without them. A merge
    history with issues is an error; `lenient_merges` leaves the ids concerned unmerged
    and reports them in `merge_issues`.
    """
    issues = cut(identity.merge_issues(history))
    if not lenient_merges and not issues.isEmpty():
        first = issues.orderBy("past_id", "issue").first()
        raise identity.MergeHistoryError(f"{first['issue']}: {first['past_id']}")
    merge_map = cut(identity.resolve_merges(history))
    resolved = identity.remap_customers(events, merge_map)
    people = cut(profiles.build_profiles(resolved, reference, merge_map))
    affinity = cut(profiles.category_affinity(resolved))
    made = clustering.create_segments(people, affinity, k, k_range, seed, restarts, predictions=predictions)
    robust = stability.segment_robustness(clustering.with_segment(people, made.members), include_sampling)
    described = made.segments.join(robust, "segment_id", "left")
    everyone = people.agg(F.count("*")).scalar()
    if strict_order:
        checked = scoring.viability(scoring.ready(described), everyone)
        judged = scoring.evaluate_actionability(checked)
    else:
        judged = scoring.viability(scoring.evaluate_actionability(described), everyone)
    rows = cut(whitespace.category_engagement(affinity, clustering.valued_by(people, predictions)))
    statistics, found = whitespace.alike(rows, whitespace.KEYS, whitespace.CATEGORY_FEATURES)
    found = cut(found)
    categories = cut(whitespace.category_whitespace(rows, statistics, found))
    per_category = whitespace.segment_whitespace(made.members, found, categories)
    ranked = scoring.priority(scoring.usability(judged).join(whitespace.segment_opportunity(per_category), "segment_id", "left"))
    return {
        "merge_map": merge_map, "merge_issues": issues, "profiles": people, "affinity": affinity, "members": made.members, "segments": cut(ranked), "lookalikes": found,
        "category_whitespace": categories, "segment_whitespace": per_category, "cluster_statistics": made.statistics,
    }
