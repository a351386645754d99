"""Feature histories that grow with every batch of exports.

The table holds the feature rows of all activities so far, in a fixed number of buckets by runner. A batch
touches the buckets of its runners only. There, what a new activity changes begins at its own date: earlier
rows keep their features, later rows of that runner are computed again from 30 days and a few runs of context
before the earliest change. Files may thus arrive late and in any order, and the table always equals one
computed from all rows at once.

Every batch writes the touched buckets to a folder of its own and then a commit record, the folder that holds
each bucket. Readers follow the newest record, so a batch shows as a whole or not at all; a batch that died is
run again over the state before it, a batch that is committed is not run again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceforge import schema
from paceforge.operators import numbering
from paceforge.operators.skew import DEFAULT_POLICY, SplitPolicy
from paceforge.plans import flow
from paceforge.schema import q
from paceforge.session import stage

#: Days of history that trailing windows look back.
CONTEXT_DAYS = 30
_COMMIT = "batch long, bucket int, folder string"


def canonical(rows: DataFrame) -> DataFrame:
    """Cleaned rows with all canonical columns, so that exports of different columns fit one table."""
    kinds = {"activity_id": "string", "runner_id": "string", "date": "timestamp_ntz", "activity_type": "string"}
    out = []
    for c in schema.CANONICAL_COLUMNS:
        kind = kinds.get(c, "double")
        out.append((F.col(q(c)) if c in rows.columns else F.lit(None)).cast(kind).alias(c))
    return rows.select(*out)


@dataclass(frozen=True)
class History:
    """A history under ``root``. ``buckets`` and ``lags`` belong to the table and must not change."""

    spark: SparkSession
    root: str
    buckets: int = 64
    lags: int = 4
    policy: SplitPolicy = field(default=DEFAULT_POLICY)

    # ------------------------------------------------------------ commit records

    def _records(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def _state(self) -> tuple[int | None, dict[int, str]]:
        """Newest committed batch and the folder of each bucket; as many rows as buckets."""
        records = self._records()
        if records is None:
            return None, {}
        last = records.agg(F.max("batch")).first()[0]
        if last is None:
            return None, {}
        return last, {r["bucket"]: r["folder"] for r in records.filter(F.col("batch") == last).collect()}

    def _rows(self, folders: dict[int, str], only: set[int] | None = None) -> DataFrame | None:
        paths = [f"{folder}/bucket={b}" for b, folder in sorted(folders.items()) if only is None or b in only]
        return self.spark.read.parquet(*paths).withColumn("bucket", self._bucket()) if paths else None

    def read(self) -> DataFrame:
        """All activities so far with their features, paces as minutes."""
        found = self._rows(self._state()[1])
        if found is None:
            raise FileNotFoundError(f"no committed batch under {self.root}")
        return found

    # ------------------------------------------------------------ batches

    def _bucket(self) -> Column:
        """By runner; rows without one have no history and are spread by activity."""
        key = F.coalesce("runner_id", "activity_id", F.col("date").cast("string"))
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def update(self, rows: DataFrame, batch: int) -> bool:
        """Add cleaned ``rows`` as batch number ``batch``; False if that batch is committed already.

        An activity of a runner that is known replaces the earlier one; in a batch the latest date wins.
        Rows without an activity id are all kept, rows without a date or runner get no history features.
        Batches are applied one after another, in the order of their numbers.
        """
        newest, folders = self._state()
        if newest is not None and batch <= newest:
            return False
        new = stage(self._distinct(canonical(rows)).withColumn("bucket", self._bucket()), "history-new")
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most the buckets
        folder = f"{self.root}/data/batch={batch}"
        if touched:
            out = self._merged(new, self._rows(folders, touched))
            # many small buckets share a task, a bucket that a hot runner fills is split
            out.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        record = {**folders, **dict.fromkeys(touched, folder)}
        commit = self.spark.createDataFrame([(batch, b, f) for b, f in record.items()], _COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/at={batch}")
        return True

    def _distinct(self, rows: DataFrame) -> DataFrame:
        named = F.col("activity_id").isNotNull()
        rest = [c for c in rows.columns if c not in ("activity_id", "runner_id")]
        # the date leads the struct, so the latest one is the greatest
        order = ["date", *[c for c in rest if c != "date"]]
        one = rows.filter(named).groupBy("runner_id", "activity_id").agg(F.max(F.struct(*map(q, order))).alias("r"))
        return one.select("activity_id", "runner_id", "r.*").select(*map(q, rows.columns)).unionByName(rows.filter(~named))

    def _merged(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """Rows of the touched buckets after the batch."""
        columns = [*schema.CANONICAL_COLUMNS, "bucket"]
        fresh = new.select(*map(q, columns), F.lit(True).alias("_fresh"))
        if old is None:
            return self._features(fresh)
        # stored rows meet the ids of the batch by their keys alone; few of them are replaced
        ids = new.filter("activity_id IS NOT NULL").select(F.col("runner_id").alias("r"), F.col("activity_id").alias("a"))
        same = F.col("runner_id").eqNullSafe(F.col("r")) & (F.col("activity_id") == F.col("a"))
        replaced = stage(old.select("runner_id", "activity_id", "date").join(ids, same, "left_semi"), "history-replaced")
        gone = replaced.select(F.col("runner_id").alias("r"), F.col("activity_id").alias("a"))
        # a replaced activity changes what follows its old place as well
        begins = new.select("runner_id", "date").unionByName(replaced.select("runner_id", "date"))
        begins = begins.filter("runner_id IS NOT NULL AND date IS NOT NULL").groupBy("runner_id")
        begins = stage(begins.agg(F.min("date").alias("_begin")), "history-begins")
        # no dated row of a runner before its earliest change is replaced, so only the others are looked up
        placed = F.col("runner_id").isNotNull() & F.col("date").isNotNull()
        unchanged = (
            old.filter(placed).join(begins, "runner_id", "left").filter("_begin IS NULL OR date < _begin").drop("_begin")
            .unionByName(old.filter(~placed).join(gone, same, "left_anti"))
        )
        # flow.features doubles the cadence, so what is computed again starts from the recorded one
        timed = old.filter(placed).select(*map(q, columns)).join(begins, "runner_id")
        near = F.col("date") > F.col("_begin") - F.expr(f"INTERVAL '{CONTEXT_DAYS}' DAY")
        recorded = F.col("average_cadence") / 2
        moved = timed.filter(near).join(gone, same, "left_anti").withColumn("_fresh", F.col("date") >= F.col("_begin"))
        # limited to a few rows of a runner before the shuffle
        order = Window.partitionBy("runner_id").orderBy(F.desc("date"), F.desc("_order"))
        runs = flow.sortable(timed.filter(~near).select(*map(q, columns), F.col("activity_id").alias("_order")), "_order")
        last = runs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, self.lags)).withColumn("_fresh", F.lit(False))
        again = moved.select(*map(q, columns), "_fresh").unionByName(last.select(*map(q, columns), "_fresh"))
        again = again.withColumn("average_cadence", recorded)
        computed = self._features(fresh.unionByName(again))
        return unchanged.select(*map(q, computed.columns)).unionByName(computed)

    def _features(self, rows: DataFrame) -> DataFrame:
        return flow.features(stage(rows, "history-rows"), self.lags, self.policy).filter("_fresh").drop("_fresh")

    # ------------------------------------------------------------ runner numbers

    def number_runners(self, batch: int) -> DataFrame:
        """Runner numbers (runner_id, number, since) that never change: each batch numbers its new runners
        behind the known ones, by id. Written once a batch, like the buckets."""
        path = f"{self.root}/runners"
        runners = self.read().filter("runner_id IS NOT NULL").select("runner_id").distinct()
        try:
            known = self.spark.read.schema("runner_id string, number long, since long").parquet(path).filter(F.col("since") < batch)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = self.spark.createDataFrame([], "runner_id string, number long, since long")
        known = stage(known, "history-runners")
        last = known.agg(F.max("number")).first()[0] or 0
        added = numbering.number_sorted(runners.join(known, "runner_id", "left_anti"), ["runner_id"], "place")
        added = added.select("runner_id", (F.col("place") + last).alias("number"), F.lit(batch).cast("long").alias("since"))
        added.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        return self.spark.read.schema("runner_id string, number long, since long").parquet(path)
