"""Ledger of daily partials that stays right when two customers are merged after their days were written.

One stream carries events and merges. Every micro-batch appends additive rows per customer and
day; nothing written is ever changed. A merge moves what its old id owns: the ledger's rows of
that id are summed and written once more, with opposite sign under the old id and as they are
under the surviving one. Sums of the ledger are therefore the batch result at any time; an old id
comes out with no events and is left out, and with it its first and last instants, which cannot
be subtracted.

A batch applies its merges first, then its events under the merge map that includes them, so an
event of a merged id never lands under the old one again. Chains are followed to their end: a
later merge moves what earlier merges brought.

A batch writes to folders of its own number and reads only those of smaller numbers. When it is
repeated after a failure it does the same again and replaces what it had begun. The ledger is
cut by a hash of the customer, so that a merge reads the parts of the ids it moves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.functions.joins import join_unique
from patronlens.functions.lineage import cut
from patronlens.operators import identity
from patronlens.streaming.events import ADDED, daily_partials

PARTS = 64
INSTANTS = ("first_seen", "last_seen", "first_purchase", "last_purchase")
_MEASURES = ", ".join(f"{c} decimal(38,6)" if c == "revenue" else f"{c} long" for c in ADDED)
SCHEMA = f"customer_id string, day timestamp, {_MEASURES}, {', '.join(f'{c} timestamp' for c in INSTANTS)}, batch long, part int"
MERGES = "past_id string, internal_customer_id string, merge_timestamp timestamp, batch long"


def _part(customer: Column) -> Column:
    return F.pmod(F.xxhash64(customer), F.lit(PARTS)).cast("int")


def combined(rows: DataFrame, *keys: str) -> DataFrame:
    """Ledger rows added up; what has no events left is gone."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ADDED]
    low = [F.min(c).alias(c) for c in INSTANTS if c.startswith("first")]
    high = [F.max(c).alias(c) for c in INSTANTS if c.startswith("last")]
    return rows.groupBy(*keys).agg(*sums, *low, *high).where("n_events > 0")


class Ledger:
    """Daily partials under `folder`, a place that every executor reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str, below: int | None) -> DataFrame:
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # no batch has written there yet
        return found if below is None else found.where(F.col("batch") < below)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        kinds = [f for f in self.spark.createDataFrame([], SCHEMA).schema if f.name not in ("batch", "part")]
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        # one file a part: a customer has a row a day, so no part is large because of one customer
        typed.withColumn("part", _part(F.col("customer_id"))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}/batch={number}")

    def rows(self, below: int | None = None) -> DataFrame:
        """All ledger rows, or those of batches before `below`."""
        events, moves = (self._read(n, SCHEMA, below) for n in ("events", "moves"))
        return events.unionByName(moves)

    def history(self, below: int | None = None) -> DataFrame:
        return self._read("merges", MERGES, below)

    def totals(self) -> DataFrame:
        """Totals per customer, equal to those of all events under the merge map of all merges so far."""
        return combined(self.rows(), "customer_id")

    def days(self) -> DataFrame:
        return combined(self.rows(), "customer_id", "day")

    def fold(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: rows of events (`past_id` null) and merges (`past_id` set)."""
        merges = cut(batch.where("past_id is not null").select("past_id", "internal_customer_id", F.col("ts").alias("merge_timestamp")))
        if not merges.isEmpty():
            merges.write.mode("overwrite").parquet(f"{self.folder}/merges/batch={number}")
        merge_map = cut(identity.resolve_merges(self.history(number + 1)))
        if not merges.isEmpty():
            self._move(merge_map, merges, number)
        events = batch.where("past_id is null").drop("past_id", "internal_customer_id")
        self._write(daily_partials(remapped(events, merge_map)), "events", number)

    def _move(self, merge_map: DataFrame, merges: DataFrame, number: int) -> None:
        """Whatever the ledger holds under an id that is past now goes to the id that survives."""
        past = merges.select("past_id").distinct().join(merge_map, "past_id")
        parts = [r[0] for r in past.select(_part(F.col("past_id")).alias("part")).distinct().collect()]  # PARTS numbers at most
        held = self.rows(number).where(F.col("part").isin(parts))
        owned = combined(join_unique(held, past.withColumnRenamed("past_id", "customer_id"), ["customer_id"], F.col("day")), "customer_id", "canonical_id", "day")
        owned = cut(owned)
        out = owned.drop("canonical_id").withColumns({c: -F.col(c) for c in ADDED}).withColumns({c: F.lit(None).cast("timestamp") for c in INSTANTS})
        into = owned.drop("customer_id").withColumnRenamed("canonical_id", "customer_id")
        self._write(out.unionByName(into), "moves", number)


def remapped(events: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Events under their surviving ids; a customer with a large share of the events is split over many tasks."""
    link = merge_map.select(F.col("past_id").alias("customer_id"), F.col("canonical_id").alias("_canonical"))
    joined = join_unique(events, link, ["customer_id"], F.col("event_id"), "left")
    return joined.withColumn("customer_id", F.coalesce("_canonical", "customer_id")).drop("_canonical")


def with_merges(events: DataFrame, merges: DataFrame) -> DataFrame:
    """One table or stream of both: merges become rows with `past_id` and no event."""
    extra = {"past_id": F.lit(None).cast("string"), "internal_customer_id": F.lit(None).cast("string")}
    rows = merges.select("past_id", "internal_customer_id", F.col("merge_timestamp").alias("ts"))
    return events.withColumns(extra).unionByName(rows, allowMissingColumns=True)


def run(source: DataFrame, ledger: Ledger, checkpoint: str):
    """Fold what the stream has, batch by batch; started again it goes on where it ended."""
    return source.writeStream.foreachBatch(ledger.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
