"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the parquet tables: profiles and affinities are computed
inside the timed section, not read from an earlier one. Each is run twice and the
faster run counts, because the first run of a plan also compiles its code.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from patronlens.functions.lineage import cut
from patronlens.operators import clustering, discovery, features, reports, traits, whitespace
from patronlens.plans import inputs
from patronlens.session import local_session
from patronlens.sources import retail


def _traits(spark, folder):
    affinity = inputs.fresh_web_affinity(spark, folder)
    return traits.extract_traits(traits.with_top_affinity(inputs.fresh_web_profiles(spark, folder), affinity))


def _clusters(spark, folder):
    vectors = cut(features.cluster_features(inputs.fresh_web_profiles(spark, folder)))
    table = cut(features.as_vectors(features.standardize(vectors, features.FEATURES), features.FEATURES))
    model = clustering.fit_kmeans(table, 5)
    return clustering.cluster_sizes(model.transform(table))


def _whitespace(spark, folder):
    profiles, affinity = cut(inputs.fresh_shop_profiles(spark, folder)), cut(inputs.fresh_shop_affinity(spark, folder))
    rows = cut(whitespace.category_engagement(affinity, profiles))
    statistics, neighbours = whitespace.similarity(rows, whitespace.KEYS, whitespace.CATEGORY_FEATURES)
    return whitespace.category_whitespace(rows, statistics, whitespace.lookalikes(neighbours))


def _discovery(spark, folder):
    people = cut(inputs.fresh_shop_profiles(spark, folder))
    counts = cut(discovery.attribute_counts(discovery.attribute_rows(retail.shop_item_events(spark, folder))))
    fields = cut(discovery.classify(discovery.field_profile(counts)))
    owned = discovery.dominant_values(counts, fields.where("status = 'usable'"))
    statistics = cut(discovery.value_statistics(owned, people))
    return discovery.score_traits(fields, statistics, people.agg(F.count("*")).scalar())


HEADLINE = {
    "profiles_web": inputs.fresh_web_profiles,
    "profiles_shop": inputs.fresh_shop_profiles,
    "affinity_shop": inputs.fresh_shop_affinity,
    "customer_traits_web": _traits,
    "champions_shop": lambda s, d: reports.champion_summary(reports.champions(cut(inputs.fresh_shop_profiles(s, d)))),
    "kmeans_web": _clusters,
    "whitespace_shop": _whitespace,
    "attribute_discovery_shop": _discovery,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session("bench", shuffle_partitions=int(os.environ.get("BENCH_CPUS", "8")))
    took: dict[str, float] = {}
    for name, build in HEADLINE.items():
        if only and name not in only:
            continue
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            build(spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
