"""Windows that move by a day against windows that are summed anew."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tessel.operators import graph as G
from tessel.sources.ledger import Refused, Run
from tessel.streaming.lookbacks import UNITS, Lookback

FIRST = date(2024, 1, 1)


@pytest.fixture(scope="module")
def pairs(spark):
    """Fourteen days but for the fifth and sixth; a pair of every day, some that come and go, weights in thirds and sevenths."""
    rows = []
    for d in range(14):
        if d not in (4, 5):
            day = FIRST + timedelta(d)
            rows += [(day, "a", "b", 1 / 3 + 1 / 7)] + [(day, f"u{k}", f"v{k}", 1 / (2 + (d + k) % 7)) for k in range(9) if (d * k) % 4 < 2]
    return spark.createDataFrame(rows, "day date, uid1 string, uid2 string, weight double").cache()


def near(frame):
    return sorted((r.uid1, r.uid2, round(r.weight, 9)) for r in frame.collect())


def of(pairs, day):
    return pairs.where(F.col("day") == F.lit(day).cast("date"))


@pytest.fixture
def window(spark, tmp_path):
    return Lookback(Run(spark, str(tmp_path), "r", {}), "w", 4)


def test_every_day_is_as_summed_anew(pairs, window):
    days = sorted(str(r.day) for r in pairs.select("day").distinct().collect())
    for d in days:
        window.add(d, of(pairs, d))
        assert near(window.weights(d, 2)) == near(G.lookback(pairs, d, 4, 2)), d
        assert near(window.counts(d)) == near(G.lookback_count(pairs, d, 4)), d
    assert window.days() == days
    before = {d: window.run.committed(f"w/state/{d}") for d in days}
    window.add(days[-1], of(pairs, days[-1]))
    window.add(days[3], of(pairs, days[3]))
    assert before == {d: window.run.committed(f"w/state/{d}") for d in days}  # replays change nothing
    with pytest.raises(Refused):
        window.add("2024-01-05", of(pairs, "2024-01-05"))


def test_start_from_a_history(pairs, window):
    window.start(pairs, "2024-01-08")
    with pytest.raises(Refused):
        window.start(pairs, "2024-01-09")
    for k in range(9, 15):
        day = f"2024-01-{k:02d}"
        window.add(day, of(pairs, day))
        assert near(window.weights(day, 2)) == near(G.lookback(pairs, day, 4, 2)), day


def test_weights_are_whole_units(spark, window):
    odd = spark.createDataFrame([("a", "b", 1 / 11)], "uid1 string, uid2 string, weight double")
    with pytest.raises(Exception, match="parts of a unit"):
        window.add("2024-01-01", odd)
    assert all(UNITS % n == 0 for n in range(2, 9))


def test_stream_with_replays_and_late_rows(spark, pairs, tmp_path):
    """Batches of files; the sink is cut off in the middle of a batch, which is then given again; a late day is kept apart."""
    window, source = Lookback(Run(spark, str(tmp_path / "runs"), "r", {}), "w", 4), str(tmp_path / "in")
    put = lambda f: f.coalesce(1).write.mode("append").parquet(source)
    cut = {"left": 2}

    class Killed(Exception):
        pass

    add = window.add

    def fragile(day, rows):
        if day == "2024-01-09" and cut["left"]:
            cut["left"] -= 1
            raise Killed
        return add(day, rows)

    window.add = fragile

    def go():
        stream = spark.readStream.schema(pairs.schema).parquet(source)
        stream.writeStream.foreachBatch(window.sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)

    put(pairs.where("day <= '2024-01-07' AND day <> '2024-01-03'"))
    go()
    put(pairs.where("day > '2024-01-07' OR day = '2024-01-03'"))
    for _ in range(2):
        with pytest.raises(Exception, match="Killed"):
            go()
    assert window.days()[-1] == "2024-01-08"
    go()
    on_time = pairs.where("day <> '2024-01-03'")
    assert near(window.counts("2024-01-14")) == near(G.lookback_count(on_time, "2024-01-14", 4))
    assert near(window.counts("2024-01-07")) == near(G.lookback_count(on_time, "2024-01-07", 4))
    late = [window.run.read(f"w/late/{b}").select("day", "uid1").collect() for b in window.run.steps("w/late")]
    assert [len(r) for r in late] == [0, of(pairs, "2024-01-03").count()]


def test_empty_days(spark, pairs, window):
    window.add("2024-01-01", of(pairs, "2024-01-01"))
    for k in range(2, 6):
        window.add(f"2024-01-0{k}", pairs.limit(0))
    assert window.counts("2024-01-04").count() == of(pairs, "2024-01-01").count() and window.counts("2024-01-05").count() == 0
