import time

from tessella.streaming import jobs

KIND = "path string, destination string"


def put(spark, folder, *events):
    spark.createDataFrame(list(events), KIND).coalesce(1).write.mode("append").json(folder)


def until(what, seconds=60):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.1)
    return what()


def test_bursts_moves_and_restarts(spark, tmp_path):
    src, cp, fired = f"{tmp_path}/events", f"{tmp_path}/cp", []
    put(spark, src, ("warm.txt", None))
    stream = spark.readStream.schema(KIND).json(src)
    keep = lambda session, rows: fired.extend((r.path, r.n_events) for r in rows.collect())
    query = jobs.on_quiet(stream, keep, cp, 6000, "300 milliseconds")
    try:
        assert until(lambda: query.recentProgress and query.recentProgress[-1]["batchId"] >= 0)
        put(spark, src, ("a.md", None), ("pic.png", None), ("draft.tmp", "b.PDF"))  # a move into what is watched
        for _ in range(2):
            time.sleep(1)
            put(spark, src, ("a.md", None))  # a burst puts the timer off
        assert not fired
        assert until(lambda: len(fired) >= 2)
        assert sorted(fired) == [("a.md", 3), ("b.PDF", 1)]
        put(spark, src, ("a.md", "c.md"))
        assert until(lambda: query.lastProgress and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2)
    finally:
        query.stop()
    assert len(fired) == 2  # the timer still runs
    query = jobs.on_quiet(stream, keep, cp, 6000, "300 milliseconds")
    try:
        assert until(lambda: len(fired) >= 4)
        time.sleep(1)
    finally:
        query.stop()
    assert sorted(fired[2:]) == [("a.md", 1), ("c.md", 1)]
