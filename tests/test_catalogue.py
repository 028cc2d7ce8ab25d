"""Every catalogue query against DuckDB on the smallest tables, and operators on rows written here."""

import json
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from weft import schema as S
from weft.functions import codec, color, text
from weft.operators import curate, match, neardup, raster, search, social, store, tables, wardrobe
from weft.plans import catalogue
from weft.sources import files
from weft.sources.views import TABLES
from weft.streaming import live

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(frame):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_is_as_in_duckdb(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and "search_all_relevant" in __spark_entry__.queries()


def test_every_stored_table_has_reads_and_writes():
    assert len(tables.READS) + len(tables.WRITES) == 129  # and one join, favorite_styles_join
    assert {n.split(".")[0] for n in [*tables.READS, *tables.WRITES]} == set(S.TABLES)


def test_upsert_update_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(store.upsert(old, new, "id")) == rows(store.upsert(store.upsert(old, new, "id"), new, "id")) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "N")], key=repr)
    assert rows(store.replace(old, new, "id")) == sorted([(1, "a"), (2, "B"), (None, "N")], key=repr)
    assert rows(store.delete(old, F.col("id") == 1)) == sorted([(2, "b"), (None, "n")], key=repr)
    assert rows(store.update(old, F.col("id") == 2, v="x")) == sorted([(1, "a"), (2, "x"), (None, "n")], key=repr)
    with pytest.raises(ValueError):
        store.insert(old, new)
    assert [r.id for r in store.with_ids(old, new.select("v").withColumn("id", F.lit(0).cast("long")).select("id", "v"), order="v").collect()] == [3, 4, 5]


def test_tag_argument_is_a_pattern(spark):
    df = spark.createDataFrame([("1", "Party"), ("2", "art_x"), ("3", "none")], "id string, tags string").withColumn("createdAt", F.lit(1))
    assert {r.id for r in tables.read("gallery_items.observeByTag", df, "ART").collect()} == {"1", "2"}
    assert {r.id for r in tables.read("gallery_items.observeByTag", df, "a%t_x").collect()} == {"2"}


def test_codecs(spark):
    df = spark.createDataFrame([("",), (" a , ,b",), ("1,x,2",)], "c string")
    got = df.select(codec.csv_parts(F.col("c")), codec.csv_trimmed(F.col("c")), codec.csv_all(F.col("c")), codec.csv_longs(F.col("c"))).collect()
    assert [list(x) for x in got[0]] == [[], [], [], []] and [list(x) for x in got[1]] == [[" a ", "b"], ["a", "b"], [" a ", " ", "b"], []] and list(got[2][3]) == [1, 2]
    colors = spark.createDataFrame([("4278190080|2|0.5;x|1|1;5|z|y;7|99|1;8|1",)], "c string").select(codec.parse_colors(F.col("c")).alias("p"))
    assert [(p.argb, p.colorName, p.fraction) for p in colors.first().p] == [(4278190080, "GOLD", 0.5), (5, "RED", 0.0), (7, "GREY", 1.0)]
    assert colors.select(codec.format_colors(F.col("p"))).first()[0] == "4278190080|2|0.500;5|0|0.000;7|12|1.000"


@pytest.mark.parametrize("phrase,want", [
    ("Show me a wedding dress for men", {"occasions": ["WEDDING"], "gender": "MEN"}), ("simple kente for church", {"occasions": ["CHURCH"], "fabrics": ["kente"], "adjectives": ["simple"]}),
    ("network update", {"occasions": ["OFFICE", "PARTY"], "remainder": "net"}), ("   ", {"occasions": [], "remainder": ""}), ("formal women's smock", {"gender": "WOMEN", "category": "FORMAL", "fabrics": ["smock"]}),
])
def test_intents(spark, phrase, want):
    got = search.parse_intent(spark.createDataFrame([(phrase,)], "text string")).first().intent.asDict()
    assert {k: got[k] for k in want} == want


def test_colors_go_round(spark):
    argb = [0xFF000000 + x for x in (0, 0xFFFFFF, 0xFF0000, 0x00FF00, 0x0000FF, 0x123456, 0x808080, 0xD4AF37)]
    x = color.to_hsl(F.col("c"))
    back = spark.createDataFrame([(a,) for a in argb], "c long").select("c", color.from_hsl(x["h"], x["s"], x["l"]).alias("b")).collect()
    assert all(abs((r.c >> k & 255) - (r.b >> k & 255)) <= 1 for r in back for k in (0, 8, 16))
    got = spark.createDataFrame([(0xFFD4AF37,)], "c long").select(color.companions(F.col("c")), color.undertone(F.lit(0xFF8D5524)), color.companions_for(F.col("c"), F.lit(0xFF8D5524))).first()
    assert len(got[0]) == 7 and got[1] == "WARM_GOLDEN" and got[2][3] == color.GOLD


@pytest.mark.parametrize("raw,want", [("CC BY-SA 4.0", "CC BY-SA 4.0"), ("CC-BY 3.0", "CC BY 3.0"), ("<b>CC0</b>", "CC0 1.0"), ("Public Domain", "Public domain"), ("MIT License", "MIT"), ("Apache 2.0", "Apache-2.0"), ("CC BY-NC 2.0", None), ("All rights reserved", None), ("", None), (None, None), ("unclear", None)])
def test_licences(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(text.license_name(F.col("c"))).first()[0] == want


def test_hosts_and_outcomes(spark):
    df = spark.createDataFrame([("https://www.Shutterstock.com/x",), ("http://a.org",), ("nohost",), (None,)], "u string")
    assert [r[0] for r in df.select(text.host_blocked(F.col("u"))).collect()] == [True, False, True, True]
    one = lambda u, licence, label: spark.range(1).select(curate.outcome(F.lit(u), F.lit(licence), F.lit(label), S.CATEGORIES)).first()[0]
    assert [one("http://a.org", "CC0", "KENTE"), one("http://a.org", "nc", "KENTE"), one("http://a.org", "CC0", "PAPER"), one("file:///x", "CC0", "KENTE")] == [None, "licence", "unknown label", "local file"]


def test_ranker_context_raises_the_score(spark):
    fabric = spark.createDataFrame([(1, "KENTE", "STRIPED", "WOVEN", 0.7, 0.75, [(0xFFD4AF37, "GOLD")], ["WEDDING", "CEREMONY"])], "id long, category string, pattern string, texture string, motifScale double, saturation double, colors array<struct<argb:bigint,colorName:string>>, suggestedUses array<string>")
    styles = spark.createDataFrame([(0, "kaba", "WOMEN", "TRADITIONAL", "KABA", ["WEDDING", "CEREMONY"], ["KENTE"], 0.75), (1, "shirt", "MEN", "CASUAL", "PRINT_SHIRT", ["EVERYDAY"], ["ANKARA"], 0.3)], "ordinal int, id string, gender string, category string, silhouette string, occasions array<string>, affinity array<string>, structure double")
    plain = {r.styleId: r.score for r in match.rank_styles(fabric, styles).collect()}
    rich = {r.styleId: r.score for r in match.rank_styles(fabric, styles, skin=0xFF8D5524, measurements=(170, 68, 98), anisotropy=0.65, favorites=["kaba"], gender="WOMEN").collect()}
    assert plain == {"kaba": 97, "shirt": 48} and rich["kaba"] == 98 and rich["shirt"] >= plain["shirt"]


def test_outfits(spark):
    items = spark.createDataFrame([(1, 1, "DRESS"), (2, 1, "SHIRT"), (3, 1, "SHOES"), (4, 1, "BAG"), (5, 2, "SHIRT"), (6, 3, "SHIRT"), (7, 3, "PANTS"), (8, 3, "ACCESSORIES")], "id long, owner long, type string")
    got = {(r.owner, r.id) for r in match.surprise_outfit(items, "s").collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (3, 6), (3, 7), (3, 8)}
    conf = spark.range(1).select(match.outfit_confidence(F.array(F.lit("Casual"), F.lit("Sporty"), F.lit("Formal")), F.array(F.lit("Black"), F.lit("White"), F.lit("Green"))), match.outfit_confidence(F.array(F.lit("x")), F.array(F.lit("y")))).first()
    assert tuple(conf) == (0.75, 1.0)


@pytest.mark.parametrize("most", [0, 6, 10, 13])
def test_near_pairs_against_brute_force(spark, most):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 30)
    values = [int(b) for b in base] + [int(b) ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b, n in zip(base, [0, 1, 5, 6, 7, 10, 11, 12] * 4, strict=False)] + [-1, -1, -2]
    df = spark.createDataFrame([*enumerate(values), (900, None)], "id long, hash long")
    rep = {v: min(i for i, x in enumerate(values) if x == v) for v in values}
    reps = sorted((i, v) for v, i in rep.items())
    want = {(i, j, ((a ^ b) & (1 << 64) - 1).bit_count()) for j, b in reps for i, a in reps if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= most}
    pairs, members = neardup.near_pairs(df, most)
    assert [tuple(r) for r in pairs.distinct().collect()].sort() == [tuple(r) for r in pairs.collect()].sort() and {tuple(r) for r in pairs.collect()} == want
    assert {tuple(r) for r in members.collect()} == {(i, rep[v]) for i, v in enumerate(values)} | {(900, 900)}


@pytest.mark.parametrize("name", [n for n, (_, order, _, result) in tables.READS.items() if order and result == "rows"])
def test_reads_keep_their_order(spark, name):
    from weft.plans import stored

    rows = stored.relation(spark, "/root/testdata/sf0.001", name.split(".")[0])
    order = tables.READS[name][1]
    found = [r[order.lstrip("-")] for r in tables.read(name, rows, *stored.READS[name][0]).collect()]
    assert found == sorted(found, reverse=order.startswith("-"))


def test_duplicates_and_conflicts(spark):
    rows = [(1, "a", 0), (2, "a", 1), (3, "b", 3), (4, "b", 1 << 40 | 7 << 50), (5, "a", 0), (6, "b", 0), (7, "a", (1 << 20) - 1 << 30), (8, "a", None)]
    found = {r.id: (r.status, r.of) for r in neardup.dedup(spark.createDataFrame(rows, "id long, class string, hash long"), 2).collect()}
    assert found == {1: ("ok", None), 2: ("duplicate", 1), 3: ("conflict", 1), 4: ("ok", None), 5: ("duplicate", 1), 6: ("conflict", 1), 7: ("ok", None), 8: ("ok", None)}


def test_greedy_and_groups(spark):
    ids, pairs = spark.range(6), spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1), (4, 5, 1)], "a long, b long, distance int")
    assert {r.id: r.grp for r in neardup.grouped(ids, pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    assert {r.id for r in neardup.accepted_in_order(ids, pairs).where("accepted").collect()} == {0, 2, 4}
    groups = spark.createDataFrame([("x", g, 3) for g in range(20)], "label string, grp long, n long")
    got = {r.split: r.n for r in neardup.group_split(groups).groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert got == {"train": 42, "val": 9, "test": 9}


def test_textures():
    board = np.kron(np.indices((8, 8)).sum(axis=0) % 2, np.ones((8, 8))) * 255.0
    stripes = np.tile(np.repeat([0.0, 255.0], 12), (64, 4))
    solid, b, s = raster.profile(np.full((64, 64), 90.0)), raster.profile(board), raster.profile(stripes)
    assert solid["energy"] == 1 and solid["contrast"] == 0 and b["contrast"] > 10 and s["gradient_x"] > s["gradient_y"] and s["period"] >= 3 and s["column_separation"] > 0.9 > s["row_separation"]


def test_groups_and_likes(spark):
    groups = spark.createDataFrame([(1, False, 1), (2, True, 1)], "id long, requiresApproval boolean, memberCount int")
    members = spark.createDataFrame([(1, 9, "OWNER", "ACTIVE")], "groupId long, userId long, role string, status string")
    requests = spark.createDataFrame([], "groupId long, userId long, status string")
    new = spark.createDataFrame([(1, 5), (1, 9), (2, 5), (3, 5), (1, 5)], "groupId long, userId long")
    g, m, r = social.join_group(groups, members, requests, new)
    assert {x.id: x.memberCount for x in g.collect()} == {1: 2, 2: 1} and m.count() == 2 and [tuple(x) for x in r.collect()] == [(2, 5, "PENDING")]
    g, m, r = social.approve(g, m, r, 2, 5)
    assert {x.id: x.memberCount for x in g.collect()} == {1: 2, 2: 2} and r.first().status == "APPROVED"
    g, m, r = social.approve(g, m, r, 2, 5)
    assert m.count() == 3
    posts, likes = spark.createDataFrame([(1, 0, False)], "id long, likeCount int, isLiked boolean"), spark.createDataFrame([], "galleryItemId long, userId long")
    once = spark.createDataFrame([(1, 5), (1, 5)], "galleryItemId long, userId long")
    posts, likes = social.like(*social.like(posts, likes, once), once)
    assert posts.first().likeCount == 1 and likes.count() == 1
    posts, likes = social.unlike(*social.unlike(posts, likes, 1, 5), 1, 5)
    assert posts.first().likeCount == 0 and likes.count() == 0


def test_quota_and_stories(spark):
    now = 1_700_000_000_000
    h = spark.createDataFrame([(1, "view", now)] * 4 + [(2, "purchase", now)], "userId long, kind string, timestamp long")
    bonus = spark.createDataFrame([(1, "view", 2)], "userId long, kind string, n int")
    got = {r.userId: (r.analyses, r.tryons) for r in social.quota(h, now, bonus, spark.createDataFrame([(2,)], "userId long")).collect()}
    assert got == {1: (1, 2), 2: (999, 999)}
    stories = spark.createDataFrame([(1, 7, 0, 10), (2, 7, 5, 20)], "id long, userId long, createdAt long, expiresAt long")
    assert social.active_stories(stories, 10).first().stories == 2 and social.active_stories(stories, 11).first().latest == 2


def test_chunks_and_names(spark):
    lines = spark.createDataFrame([("a", i, "x" * 500) for i in range(5)], "f string, o int, text string")
    assert [len(r.text) for r in curate.chunks(lines, "f", "o", "text").orderBy("chunk").collect()] == [1001, 1001, 500]
    names = spark.createDataFrame([("k", "a.jpg", 1), ("k", "a.jpg", 2), ("k", "b", 3)], "c string, n string, o int")
    assert sorted(r.n for r in curate.unique_names(names, "c", "n", "o").collect()) == ["a.jpg", "a_2.jpg", "b"]


def test_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": 3, "styles": [{"id": "k", "title_key": "t", "gender": "WOMEN", "occasions": ["A", "B"], "affinity": ["KENTE"], "structure": 0.5}]}))
    assert files.style_catalogue(spark, str(tmp_path / "s.json")).first().occasions == "A,B" and files.catalogue_version(spark, str(tmp_path / "s.json")).first()[0] == 3
    (tmp_path / "l.json").write_text(json.dumps({"looks": [{"id": "a", "fabrics": ["KENTE"]}, {"id": "b", "fabrics": ["PAPER"]}]}))
    assert [r.id for r in files.looks(spark, str(tmp_path / "l.json")).collect()] == ["a"]
    (tmp_path / "p.tsv").write_text("# c\n\nk\tv\nj\tw %s\n")
    assert {tuple(r) for r in files.language_pack(spark, str(tmp_path / "p.tsv")).collect()} == {("k", "v"), ("j", "w %s")}
    (tmp_path / "p.tsv").write_text("k\tv\nk\tw\n")
    with pytest.raises(ValueError):
        files.language_pack(spark, str(tmp_path / "p.tsv"))
    (tmp_path / "x.xml").write_text('<r><string name="a">A</string>\n<string name="b" x="1">B\nb</string></r>')
    assert {tuple(r) for r in files.xml_strings(spark, str(tmp_path / "x.xml")).collect()} == {("a", "A"), ("b", "B\nb")}
    files.write_zip_manifest(spark.createDataFrame([("KENTE", "1.jpg")], "category string, file string"), str(tmp_path / "z.zip"))
    assert zipfile.is_zipfile(tmp_path / "z.zip") and tuple(files.zip_manifest(spark, str(tmp_path / "z.zip")).first()) == ("KENTE", "1.jpg")
    rows = spark.createDataFrame([("a", "1"), ("b", "true")], "key string, value string")
    assert tuple(files.settings(rows, {"a": T.IntegerType(), "b": T.BooleanType(), "c": T.StringType()}).first()) == (1, True, None)


def test_streams(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/events.parque[t]")
    query = live.live(stream, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n")), "live_counts", str(tmp_path / "c"))
    query.awaitTermination(60)
    assert spark.table("live_counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, None)], "k int, o int, v string")
    assert [r.o for r in live.changes(rows, "k", "o", "v").collect()] == [1, 3, 4]


def test_audit_and_modes(spark):
    base, pack = (spark.createDataFrame(x, "key string, text string") for x in ([("a", "%s"), ("b", "x"), ("c", "y")], [("a", "%d"), ("b", " "), ("d", "z")]))
    assert {tuple(r) for r in wardrobe.pack_audit(base, pack, text.format_specifiers).collect()} == {("a", "specifiers"), ("b", "empty"), ("c", "missing"), ("d", "extra")}
    items = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, "y", 4), (1, "x", 3)], "o int, s string, i int")
    assert wardrobe.mode_of(items, "o", "s", "i").first().value == "y"
