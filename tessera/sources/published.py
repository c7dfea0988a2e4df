"""A published table: snapshots are merged into it under guards, as versions of which the last whole one is current."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import merge, relate
from tessera.session import scratch

_LOG = "step int, outcome string, reasons string, version int, digest string, n long, inserted long, updated long, retired long, deleted long"


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows, in whatever order and partitions they are: their number and two sums of row hashes."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), line).cast("decimal(38,0)"))
    return ":".join(map(str, df.agg(F.count("*"), total(1), total(2)).first()))


@dataclass(frozen=True)
class Published:
    """A table below a folder that driver and executors share. One publisher at a time.

    A version is a folder that is written whole before the log gets its row; readers take the version of the last such row, so
    a publisher that dies leaves the version before it. key: the snapshots' key; rows get an id that they keep for good.
    """

    spark: SparkSession
    folder: str
    key: str

    def log(self) -> DataFrame:
        """What each call of publish() did."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def current(self) -> DataFrame | None:
        last = self.log().where("outcome = 'written'").agg(F.max("version")).first()[0]
        return None if last is None else self.spark.read.parquet(f"{self.folder}/version={last}")

    def publish(self, snapshot: DataFrame, fields: Sequence[str], keep: Column | None = None, least_share: float = 0.5, skipped: int = 0, most_skipped: int = 10) -> str:
        """Merge a snapshot: written, unchanged (equal to the last one that was written) or refused; the log tells why.

        It is refused if it is empty, has fewer than least_share of the current rows that are not retired, more than most_skipped
        rows had been left out of it, or a key is null or stands twice: what is published then stays as it is. Rows that are
        gone are deleted, or retired where `keep`, over the current columns, is true; retired rows that come back are rows again.
        New keys get ids above all that were ever given, in their order.
        """
        new = snapshot.select(self.key, *fields)
        steps = self.log().agg(F.max("step"), F.max("version"), F.max_by("digest", F.when(F.col("outcome") == "written", F.col("step")))).first()
        step, version = (0 if x is None else x + 1 for x in steps[:2])
        digest = content_digest(new)

        def note(outcome: str, reasons: Sequence[str] = (), counts: Sequence[int] = (0, 0, 0, 0, 0), at: int | None = None) -> str:
            row = (step, outcome, ",".join(reasons), at, digest, *counts)
            self.spark.createDataFrame([row], _LOG).write.mode("append").parquet(f"{self.folder}/log")
            return outcome

        if digest == steps[2]:
            return note("unchanged")
        old = self.current()
        n, named = new.agg(F.count("*"), F.count(self.key)).first()
        twice = not new.groupBy(self.key).count().where("count > 1").isEmpty()
        before = 0 if old is None else old.where("NOT retired").count()
        wrong = {"empty": n == 0, "shrunk": n < least_share * before, "skipped": skipped > most_skipped, "no-key": named < n, "repeated-key": twice}
        if any(wrong.values()):
            return note("refused", [name for name, is_so in wrong.items() if is_so])
        if old is None:
            old = new.limit(0).withColumns({"id": F.lit(0).cast("long"), "retired": F.lit(False)})
        acted = merge.actions(old, new, self.key, fields, keep)
        known = old.select(self.key, "id", F.col("retired").alias("was_retired"))
        told = scratch(acted.join(known, self.key, "left"), "acted")
        last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        top = self.spark.read.parquet(f"{self.folder}/ids").agg(F.max("last")).first()[0] if version else 0
        fresh = relate.numbered(told.where("id IS NULL").select(self.key), [self.key]).select(self.key, (F.col("place") + max(last, top)).alias("fresh"))
        merged = merge.merged(told.drop("was_retired")).join(fresh, self.key, "left").withColumn("id", F.coalesce("id", "fresh"))
        merged.select(self.key, *fields, "id", "retired").write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        count = lambda hit: F.count_if(hit)
        action, again = F.col("action"), F.coalesce("was_retired", F.lit(False))
        back = again & action.isin("skip", "update")
        counts = told.agg(
            count(action != "delete"), count((action == "insert") | back), count((action == "update") & ~again), count((action == "retire") & ~again), count(action == "delete")
        ).first()
        given = told.where("id IS NULL").count()
        self.spark.createDataFrame([(max(last, top) + given,)], "last long").write.mode("append").parquet(f"{self.folder}/ids")
        return note("written", counts=counts, at=version)
