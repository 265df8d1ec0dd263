"""Lookbacks that move by a day: the new day is added and the day that leaves is taken off, in whole units, so that nothing drifts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.relational import union_all
from tessel.sources.ledger import Refused, Run

#: Units of a weight of 1: the least number that 2 to 8 divide, as a key's weight is shared by 2 to 8 uids.
UNITS = 840


def whole_units(weight: Column, units: int = UNITS) -> Column:
    """A weight in whole units; a weight that is no multiple of one unit is an error, as sums of it could not be taken back."""
    n = F.round(weight * units)
    return F.when(F.abs(weight * units - n) > 1e-6, F.raise_error(F.concat(F.lit("weight in parts of a unit: "), weight.cast("string"))).cast("long")).otherwise(n.cast("long"))


class Lookback:
    """§2.11, G07, G08: sums of the last `days` days of pair rows (day, uid1, uid2, weight), kept as steps of a run.

    `<name>/pairs/<day>` holds a day's rows in units and `<name>/state/<day>` the window that ends there, one row (uid1, uid2, units, n) for each
    pair with a row in it. A day reads the window before it, its own rows and those of the days that leave; older days are never
    read again. All are steps of the ledger: a day that is given again is not written again, and one that was cut off goes on. Days come
    in order; a gap is made up for. A day before the newest is refused. Rows of a null uid are a pair's like any other.
    """

    def __init__(self, run: Run, name: str, days: int, units: int = UNITS):
        self.run, self.name, self.length, self.units = run, name, days, units

    def days(self) -> list[str]:
        """Days that have a window, in order."""
        return self.run.steps(f"{self.name}/state")

    def _rows(self, pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.select("uid1", "uid2", whole_units(F.col("weight"), self.units).alias("units"), *more)

    def start(self, pairs: DataFrame, day: str) -> DataFrame:
        """The first window from all rows up to `day` at once; the rows of its days are kept, as they leave one by one."""
        first = str(date.fromisoformat(day) - timedelta(self.length - 1))
        known = self.days()
        if known and known[0] != day:
            raise Refused(f"{self.name} starts on {known[0]}")
        recent = pairs.where(F.col("day").between(F.lit(first).cast("date"), F.lit(day).cast("date")))
        kept = self.run.table(f"{self.name}/history", self._rows(recent, "day"), ["day"])
        return self.run.table(f"{self.name}/state/{day}", kept.groupBy("uid1", "uid2").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("n")))

    def _leaving(self, low: str, high: str) -> list[DataFrame]:
        """Rows of the days after `low` up to `high`."""
        found = [self.run.read(f"{self.name}/pairs/{d}") for d in self.run.steps(f"{self.name}/pairs") if low < d <= high]
        if self.run.committed(f"{self.name}/history"):
            days = F.col("day").between(F.date_add(F.lit(low).cast("date"), 1), F.lit(high).cast("date"))
            found.append(self.run.read(f"{self.name}/history").where(days).drop("day"))
        return found

    def add(self, day: str, pairs: DataFrame) -> DataFrame:
        """The window that ends on `day`, whose rows are given."""
        known = self.days()
        if known and day < known[-1] and day not in known:
            raise Refused(f"{day} comes after {known[-1]} was summed")
        new = self.run.table(f"{self.name}/pairs/{day}", self._rows(pairs))
        moves, before = [new.withColumn("n", F.lit(1).cast("long"))], [d for d in known if d < day]
        if before:
            back = lambda d: str(date.fromisoformat(d) - timedelta(self.length))
            moves.append(self.run.read(f"{self.name}/state/{before[-1]}"))
            moves += [f.select("uid1", "uid2", (-F.col("units")).alias("units"), F.lit(-1).cast("long").alias("n")) for f in self._leaving(back(before[-1]), back(day))]
        summed = union_all(moves).groupBy("uid1", "uid2").agg(F.sum("units").alias("units"), F.sum("n").alias("n")).where("n > 0")
        return self.run.table(f"{self.name}/state/{day}", summed)

    def weights(self, day: str, least: int = 3) -> DataFrame:
        """G07 on a day that has a window."""
        return self.run.read(f"{self.name}/state/{day}").where(F.col("n") >= least).select("uid1", "uid2", (F.col("units") / F.lit(float(self.units))).alias("weight"))

    def counts(self, day: str) -> DataFrame:
        """G08 on a day that has a window."""
        return self.run.read(f"{self.name}/state/{day}").select("uid1", "uid2", F.col("n").cast("double").alias("weight"))

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch sink of pair rows whose days are whole within a batch. The first run of a batch says which days it brings; those not yet
        summed are added in order, and its rows of other days (late ones) are kept as step `<name>/late/<batch>`. A batch that is
        given again, or was cut off anywhere, leaves what one run leaves. The days of a batch are listed on the driver, a row each."""
        known = self.days()
        seen = sorted(str(r.day) for r in batch.select("day").where("day IS NOT NULL").distinct().collect())
        new = [d for d in seen if not known or d > known[-1]]
        mine = self.run._put(f"{self.name}/batches/{batch_id}.json", {"days": new})["days"]
        batch = batch.persist()
        try:
            for d in mine:
                self.add(d, batch.where(F.col("day") == F.lit(d).cast("date")))
            late = batch.where(F.col("day").isNull() | ~F.col("day").cast("string").isin(mine)) if mine else batch
            self.run.publish(f"{self.name}/late/{batch_id}", late)
        finally:
            batch.unpersist()
