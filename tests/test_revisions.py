"""Last records over micro-batches: revisions, late ones, rows without id, and state that ends."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tectra.schemas import CATALOG, CATALOG_COLUMNS
from tectra.streaming import live

SCHEMA = f"{CATALOG}, seen_at timestamp, ord long"
T0 = datetime(2026, 1, 1)


def row(key, mag, minute, order=0, place="p"):
    return (key, datetime(2020, 1, 1), 38.0, 30.0, None, mag, "ML", place, T0 + timedelta(minutes=minute), order)


def test_revisions_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "changes")
    dropped, states = 0, []

    def poll(*rows):
        """Another micro-batch; what it changes, by id."""
        nonlocal dropped
        spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(src)
        changes = []

        def keep(batch, n):
            changes.extend((r.id, r.mag, r.n_records, r.n_late) for r in batch.collect())

        q = live.last_records(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        for p in q.recentProgress:
            for s in json.loads(json.dumps(p["stateOperators"])) if isinstance(p, dict) else json.loads(p.json)["stateOperators"]:
                dropped += s["numRowsDroppedByWatermark"]
                states.append(s["numRowsTotal"])
        return sorted(changes, key=str)

    assert poll(row("a", 1.0, 0), row("b", 1.0, 0), row("a", 1.5, 0, 1)) == [("a", 1.5, 2, 0), ("b", 1.0, 1, 0)]
    assert poll(row("a", 2.0, 3)) == [("a", 2.0, 3, 0)]  # a revision in another batch wins
    assert poll(row("a", 9.0, 1), row("b", 9.0, 2)) == [("b", 9.0, 2, 0)]  # one that comes late doesn't
    assert poll(row("a", 2.5, 3, 5)) == [("a", 2.5, 5, 1)]  # and is counted
    assert poll(row(None, 1.0, 4, 0, "x"), row(None, 1.0, 4, 0, "y"), row(None, 1.0, 4, 0, "x")) == [(None, 1.0, 1, 0), (None, 1.0, 2, 0)]
    held = states[-1]
    assert held == 4 and dropped == 0
    # long after, the watermark has passed: old polls are dropped, and ids last seen long ago are forgotten
    poll(row("c", 1.0, 500))
    assert poll(row("a", 7.0, 1), row("c", 2.0, 501)) == [("c", 2.0, 2, 0)]
    assert dropped == 1 and states[-1] < held
    assert poll(row("a", 3.0, 502)) == [("a", 3.0, 1, 0)]
    assert not (tmp_path / out).exists()


def test_revisions_reach_the_archive(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "archive")
    for rows in ([row("a", 1.0, 0), row("b", 1.0, 0)], [row("a", 2.0, 1)], [row("a", 0.5, 0)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        live.revisions_stream(spark.readStream.schema(SCHEMA).parquet(src), path, str(tmp_path / "cp")).awaitTermination(120)
    got = live.read_archive(spark, path)
    assert got.columns == CATALOG_COLUMNS and [(r.id, r.mag) for r in got.orderBy("id").collect()] == [("a", 2.0), ("b", 1.0)]
    assert got.filter(F.col("time") == datetime(2020, 1, 1)).count() == 2


def test_groups_of_ids(spark, tmp_path):
    """Many ids share a group's state, which forgets each in its own time; ties of one batch and of two."""
    src = str(tmp_path / "in")
    states = []

    def poll(rows, groups):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        changes = {}

        def keep(batch, n):
            for r in batch.collect():
                assert r.id not in changes
                changes[r.id] = (r.mag, r.time, r.n_records, r.n_late)

        q = live.last_records(spark.readStream.schema(SCHEMA).parquet(src), groups=groups).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        return changes

    at = datetime(2020, 1, 1)
    many = [row(str(k), float(k), 0) for k in range(3000)]
    assert poll(many, 2) == {str(k): (float(k), at, 1, 0) for k in range(3000)} and states[-1] == 2
    third = [row(str(k), None, 1, k % 2) for k in range(0, 3000, 3)] + [row("0", 7.0, 1, 0), row("0", 8.0, 0), row("1", 9.0, 0)]
    want = {str(k): (None, at, 2, 0) for k in range(3, 3000, 3)} | {"0": (7.0, at, 4, 1)}
    assert poll(third, 2) == want  # "1" came again with the place that it had
    assert poll([row("new", 1.0, 100)], 2) == {"new": (1.0, at, 1, 0)}
    assert poll([row("new", 2.0, 125), row("5", 2.0, 125)], 2) == {"new": (2.0, at, 2, 0), "5": (2.0, at, 2, 0)}
    # 120 minutes after their last records were seen, all but "new" and "5" are forgotten
    assert poll([row("new", 3.0, 140)], 2) == {"new": (3.0, at, 3, 0)}
    assert poll([row("6", 1.0, 141), row("5", 3.0, 141)], 2) == {"6": (1.0, at, 1, 0), "5": (3.0, at, 3, 0)}
