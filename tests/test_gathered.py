"""Logs, scraped answers, predictions and combined values, on planted rows and against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.operators import curate, neardup, trends, wardrobe
from weft.streaming import live


def plain_errors(lines, starts, patterns, limit):
    out, left, inside = [], 0, False
    for line in lines:
        key = (line or "").strip(" \t\n\r\x0b\x0c")
        if any(key.startswith(s) for s in starts):
            inside, left = True, limit
            out.append(key)
        elif inside:
            out.append(key)
            left -= 1
            inside = left > 0 and bool(key)
        elif any(re.search(p, line or "") for p in patterns):
            out.append(key)
    return [k for k in dict.fromkeys(out) if k]


def test_errors_of_logs(spark):
    log = ["> Task :a", "e: bad.kt", "  e: not at the start", "FAILURE: Build failed", "", "* What went wrong:", "Execution failed", "> more", "", "after", "* Exception is:", *[f"at {i}" for i in range(40)], "Could NOT resolve x", "e: bad.kt", None, "> Task :b FAILED"]
    rng = random.Random(3)
    some = ["* What went wrong:", "x", "y", "", " ", None, "error: z", "* Exception is: now", "ERROR: Z "]
    logs = {0: log, 1: [rng.choice(some) for _ in range(120)], 2: [rng.choice(some[1:4]) for _ in range(40)], 3: [None]}
    rows = [(i, k, line) for i, lines in logs.items() for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "log int, k int, line string").repartition(3)
    got = {i: [] for i in logs}
    for r in curate.log_errors(df, "log", "k", "line").orderBy("log", "k").collect():
        got[r.log].append(r.line)
    for i, lines in logs.items():
        assert got[i] == plain_errors(lines, curate.SECTION_STARTS, curate.ERROR_LINES, 25), i
    assert "at 24" in got[0] and "at 25" not in got[0] and "after" not in got[0]
    two = curate.log_errors(df, "log", "k", "line", limit=2).where("log = 1").orderBy("k").collect()
    assert [r.line for r in two] == plain_errors(logs[1], curate.SECTION_STARTS, curate.ERROR_LINES, 2)


def test_commons_pages(spark):
    info = {"mime": "image/JPEG", "width": 900, "height": 300, "url": "https://media.example.org/a.jpg", "descriptionurl": "https://media.example.org/a", "extmetadata": {"LicenseShortName": {"value": "CC BY-SA 4.0"}}}
    cases = [
        ({}, None), ({"mime": "image/gif"}, "mime image/gif unsupported"), ({"mime": None}, "mime ? unsupported"), ({"height": 299}, "original below 300px"), ({"width": None}, "original below 300px"),
        ({"extmetadata": {}}, "license rejected: unknown"), ({"extmetadata": {"LicenseShortName": {"value": ""}, "License": {"value": "CC BY-NC 2.0"}}}, "license rejected: CC BY-NC 2.0"),
        ({"extmetadata": {"License": {"value": "cc0"}}}, None), ({"descriptionurl": "https://www.pinterest.com/pin/1"}, "blocked host"), ({"descriptionurl": None, "url": "https://i.pinimg.com/1.jpg"}, "blocked host"),
    ]
    pages = [{"title": f"t{i}", "imageinfo": [info | change]} for i, (change, _) in enumerate(cases)] + [{"title": "none"}, {"title": "empty", "imageinfo": []}, {"title": "bare", "imageinfo": [{}]}]
    rows = [(1, json.dumps({"query": {"pages": pages}})), (2, "no json"), (3, None), (4, "{}"), (5, json.dumps({"query": {"pages": []}}))]
    got = curate.commons_candidates(spark.createDataFrame(rows, "id int, payload string")).collect()
    assert [(r.title, r.reason) for r in got] == [(f"t{i}", why) for i, (_, why) in enumerate(cases)] + [(t, "no imageinfo") for t in ("none", "empty", "bare")]
    assert got[0].licence == "CC BY-SA 4.0" and {r.id for r in got} == {1}


def test_openverse_results(spark):
    one = {"title": "t", "url": "https://media.example.org/1", "license": "by", "license_version": "4.0", "width": 400, "height": 500}
    cases = [({}, None), ({"url": ""}, "no url"), ({"url": None}, "no url"), ({"url": "https://pinterest.com/1"}, "blocked host"), ({"license": "by-nc-nd"}, "license rejected: by-nc-nd 4.0"), ({"license": None, "license_version": None}, "license rejected: unknown"),
             ({"license": "PDM"}, None), ({"width": 299}, "too small (299x500)"), ({"width": 0, "height": 10}, None), ({"height": None}, None)]
    rows = [(1, json.dumps({"results": [one | c for c, _ in cases]})), (2, None), (3, json.dumps({"results": None}))]
    got = curate.openverse_candidates(spark.createDataFrame(rows, "id int, payload string")).collect()
    assert [r.reason for r in got] == [why for _, why in cases] and got[0].licence == "CC BY 4.0" and got[6].licence == "Public domain"


def test_files_of_a_listing(spark):
    tree = [{"path": "a/x.JPG", "type": "blob", "size": 5}, {"path": "a/y.png", "type": "tree"}, {"path": "b/z.png", "type": "blob", "size": 1}, {"path": "a/w.png", "type": "blob"}, {"path": "a/v.webp", "type": "blob", "size": 99}, {"path": "a/n.txt", "type": "blob", "size": 1}, {"type": "blob"}]
    df = spark.createDataFrame([("r", json.dumps({"tree": tree})), ("s", None)], "repo string, payload string")
    got = curate.tree_files(df, prefixes=("a/", "c/"), most=50).collect()
    assert [(r.repo, r.path, r.size) for r in got] == [("r", "a/x.JPG", 5), ("r", "a/w.png", 0)]


def test_predictions_follow_the_line(spark):
    week, now = trends.WEEK, 100 * trends.WEEK
    rows = [(now - k * week - 5, ["up", "flat"] if j < 8 - k and j < 4 else ["up"] if j < 8 - k else ["flat"] if j < 4 else ["other"]) for k in range(8) for j in range(9)]
    rows += [(now + week, ["future"]), (now - 20 * week, ["past"])]
    got = {r.tag: r for r in trends.predictions(spark.createDataFrame(rows, "createdAt long, tags array<string>"), now).collect()}
    assert set(got) == {"up", "flat", "other"}
    up = got["up"]  # 1, 2 ... 8 posts a week: 9 are next
    assert up.growth == pytest.approx(100.0) and up.confidence == pytest.approx(1.0) and up.peak == now + 7 * 86_400_000
    assert got["flat"].growth == pytest.approx(0) and 0.5 <= got["other"].confidence <= 1


def test_accuracy_of_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("z", "b"), (None, "a")], "truth string, guess string")
    r = wardrobe.accuracy_summary(df, "truth", "guess", ["a", "b", "c"]).first()
    assert (r.n, r.correct, r.macro, r.classes_without_rows) == (5, 2, 0.75, 1) and r.overall == pytest.approx(0.4)
    r = wardrobe.accuracy_summary(df.limit(0), "truth", "guess", ["a"]).first()
    assert (r.n, r.overall, r.macro, r.classes_without_rows) == (0, None, None, 1)


def test_combined_values_of_a_stream_are_those_of_all_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randrange(4), rng.choice(["a", "b", "c", "other", None]), rng.choice([None, 1.5, 2.0, 7.25])) for i in range(300)]
    schema = "n long, user int, kind string, value double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[0] // 100 == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    slots = ["a", "b", "c"]
    want = live.latest_of_all(spark.createDataFrame(rows, schema), slots, "user", "kind", "value", ["n"]).collect()
    held, plain = {}, []
    for n, user, kind, value in rows:
        if kind in slots and value is not None:
            held.setdefault(user, {})[kind] = value
            if len(held[user]) == 3:
                plain.append((user, n, *[held[user][s] for s in slots]))
    assert sorted(map(tuple, want)) == sorted(plain)
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = live.combine_latest(stream, slots, "user", "kind", "value", ["n"])
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 3  # three batches, each with the state of those before
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("user", "n", *slots).collect()) == sorted(plain)
    assert live.latest_of_all(spark.createDataFrame([], schema), slots, "user", "kind", "value", ["n"]).collect() == []


def plain_accepted(ids, pairs):
    low = {}
    for a, b in pairs:
        low.setdefault(b, set()).add(a)
    out = set()
    for i in sorted(ids):
        if not low.get(i, set()) & out:
            out.add(i)
    return out


def test_ids_are_accepted_in_order(spark):
    rng = random.Random(4)
    for n, m in ((30, 25), (30, 60), (12, 60)):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        got = neardup.accepted_in_order(spark.range(n), spark.createDataFrame(pairs, "a long, b long")).where("accepted").collect()
        assert {r.id for r in got} == plain_accepted(range(n), pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, kept = [], neardup.checkpointed
    monkeypatch.setattr(neardup, "checkpointed", lambda df: rounds.append(1) or kept(df))
    n = 10_000
    chain = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    got = neardup.accepted_in_order(spark.range(n), chain).where("accepted").collect()
    assert sorted(r.id for r in got) == list(range(0, n, 2)) and len(rounds) < 50


def test_the_staging_gate(spark):
    rows = [(1, "A", "x", 300, 300, 0), (2, "A", "x", 300, 300, 1), (3, "B", "y", 300, 300, 3), (4, "A", "x", 300, 300, -1), (5, "Z", "x", 300, 300, 255 << 20), (6, "A", "x", 100, 300, 255 << 40), (7, "A", "", 300, 300, 255 << 40),
            (8, None, "x", 300, 300, 7), (9, "A", None, None, 300, 9), (10, "A", "x", 300, 300, None), (11, "B", "x", 300, 300, 255 << 40)]
    df = spark.createDataFrame(rows, "id long, class string, stem string, w int, h int, hash long").withColumn("creator", F.lit("c"))
    outcomes, credits = neardup.staged(df, ["A", "B"], most=2)
    assert {r.id: r.outcome for r in outcomes.collect()} == {
        1: "ok", 2: "duplicate of A/x.jpg", 3: "cross-class conflict with A/x.jpg", 4: "ok", 5: "unknown class", 6: "too small (100x300)", 7: "ok", 8: "unknown class", 9: "too small (?x300)", 10: "ok", 11: "cross-class conflict with A/A.jpg"}
    assert {r.id: (r["class"], r.filename, r.creator) for r in credits.collect()} == {1: ("A", "x.jpg", "c"), 4: ("A", "x_2.jpg", "c"), 7: ("A", "A.jpg", "c"), 10: ("A", "x_3.jpg", "c")}


def test_sorted_rows_are_numbered(spark):
    from weft.operators import store

    values = [random.Random(k).randrange(1000) for k in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = store.numbered(df.orderBy("v")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501)) and [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted(values)
    assert store.numbered(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [0, 3, 6, 10, 15])
def test_near_hashes_are_all_pairs(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(30)]
    made = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 17))) for b in base * 6} | set(base) | {0, (1 << 64) - 1, 1 << 63, 0xFFFF}
    signed = [x - (1 << 64) if x >> 63 else x for x in made]
    got = [(r.a, r.b, r.distance) for r in neardup.near_hashes(spark.createDataFrame([(x,) for x in signed], "hash long"), most).collect()]
    want = [(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= most]
    assert sorted(got) == sorted(want)
