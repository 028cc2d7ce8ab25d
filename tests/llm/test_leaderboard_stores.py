"""What the leaderboard's streams leave open."""

from __future__ import annotations

from weft.llm import leaderboard


def open_stores(spark) -> int:
    """How many state stores this JVM holds open."""
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    one = kind.getField("MODULE$").get(None)
    field = next(f for f in kind.getDeclaredFields() if f.getName().endswith("loadedProviders"))
    field.setAccessible(True)
    return field.get(one).size()


def test_no_batch_leaves_its_stores_open(spark):
    before = open_stores(spark)
    rows = [(b, 10 * b, 10 * b, n % 3, n, 100 + n) for b in (1, 2) for n in range(12)]
    feed = leaderboard.change_feed(spark.createDataFrame(rows, "batch int, seen int, day int, board int, item long, amount long"), k=2, buckets=2)
    assert {r.batch for r in feed.collect()} == {1} and feed.where("change = 'enter'").count() == 6
    assert open_stores(spark) <= before
