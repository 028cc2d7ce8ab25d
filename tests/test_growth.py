"""What lets queries grow: no broadcast of multiplied rows, values computed once, pairs made by all cores."""

import pytest
from pyspark.sql import functions as F

from weft.functions import color, text
from weft.operators import advice, community, match, neardup
from weft.sources.views import view

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_hashes_broadcast_no_multiplied_rows(spark, tmp_path):
    path = str(tmp_path / "hashes.parquet")  # a file, whose size is known and small
    spark.createDataFrame([(0,), (7,), (-1,), (1 << 62,)], "hash long").write.parquet(path)
    found = neardup.near_hashes(spark.read.parquet(path), 10)
    assert {tuple(sorted(r[:2])) + (r[2],) for r in found.collect()} == {(0, 7, 3), (0, 1 << 62, 1), (7, 1 << 62, 4)}
    assert "BroadcastHashJoin" not in _plan(found)


def test_difference_hash_names_its_picture_once(spark):
    made = str(neardup.difference_hash(F.concat("marker", F.slice("marker", 1, 8))))
    assert made.count("marker") == 2


def test_rounds_of_groups_do_not_find_pairs_again(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    ids = spark.range(6)
    pairs = ids.where("id < 5").select(counted("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in neardup.grouped(ids, pairs).collect()} == {(i, 0) for i in range(6)}
    assert seen.value <= 20


@pytest.mark.parametrize("made", [color.companions, lambda c: color.skin_harmony(F.array(c), F.lit(0xFF8D5524)), color.to_hsl, lambda c: color.companions_for(c, F.lit(0xFF8D5524))])
def test_colours_are_computed_once(spark, made):
    assert str(made(F.col("marker"))).count("marker") <= 3


def test_all_pairs_are_made_by_all_cores(spark):
    fabrics, styles = view(spark, SF, "fabrics"), view(spark, SF, "styles")
    cores = spark.sparkContext.defaultParallelism
    for pairs in (match.rank_styles(fabrics, styles, skin=0xFF8D5524), match.features(fabrics, styles), match.top_styles(fabrics, styles), advice.feature_vector(fabrics, styles)):
        assert "CartesianProduct" not in _plan(pairs)
        assert pairs.rdd.getNumPartitions() >= cores


def test_top_styles_are_the_best_of_all_without_a_sort(spark):
    fabrics, styles = view(spark, SF, "fabrics"), view(spark, SF, "styles")
    wearer = {"skin": 0xFF8D5524, "measurements": (178, 68, 98), "anisotropy": 0.65, "favorites": ["kaba_gala"], "gender": "WOMEN"}
    gone = styles.where("id = 'gown_evening'").select(F.col("id").alias("styleId"))
    found = match.top_styles(fabrics, styles, 4, gone, **wearer)
    assert "Window" not in _plan(found)
    want = match.best_styles(match.rank_styles(fabrics, styles, gone, **wearer), 4)
    assert found.columns == want.columns and found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_variation_texts(spark):
    looks = spark.createDataFrame([(1, "g"), (12, "g"), (2, "g"), (3, "h"), (4, None), (-5, "g"), (21, "g")], "id long, variationGroup string")
    want = {r.id: ",".join(map(str, r.others)) for r in community.variations(looks).collect()}
    assert {r.id: r.others for r in community.variation_texts(looks).collect()} == want
    assert want[1] == "-5,2,12,21" and want[3] == "" and want[4] == ""


def test_variation_texts_come_longest_first(spark):
    sizes = {"a": 2, "b": 40, "c": 300, "d": 5, None: 30}  # a Parquet writer gathers thousands of long rows behind short ones
    looks = spark.createDataFrame([(k * 1000 + i, g) for k, (g, n) in enumerate(sizes.items()) for i in range(n)], "id long, variationGroup string")
    parts = community.variation_texts(looks).rdd.glom().collect()
    seen = [[len(r.others.split(",")) if r.others else 0 for r in part] for part in parts]
    assert sorted(n for part in seen for n in part) == sorted(max(0, n - 1) if g else 0 for g, n in sizes.items() for _ in range(n))
    assert all(part == sorted(part, reverse=True) for part in seen)
    assert not any(0 in part and max(part) for part in seen)


@pytest.mark.parametrize("shares", [1, 3, 32])
def test_variation_texts_in_shares(spark, shares):
    looks = spark.createDataFrame([(i * 37 % 101 - 50, "gh"[i % 7 == 0]) for i in range(90)] + [(7, "g"), (7, "g"), (7, "h"), (7, None), (None, "g"), (None, None), (900, "i")], "id long, variationGroup string")
    text = lambda rows: sorted((str(r.id), r.others if isinstance(r.others, str) else ",".join(map(str, r.others))) for r in rows)
    want = text(community.variations(looks.where("id IS NOT NULL")).collect()) + [("None", ""), ("None", "")]
    assert text(community.variation_texts(looks, shares).collect()) == sorted(want)


def test_licence_searches_only_texts_with_a_part(spark):
    said = {"CC<b>x</b>BY": None, "CC<b> BY-SA 4.0": "CC BY-SA 4.0", "c c0": None, "Public\tDomain": "Public domain", "pd": "Public domain", "PDM": "Public domain", "an Apache 2": "Apache-2.0", "BSD 3": "BSD-3-Clause", "the MIT": "MIT", "unlicense": "Unlicense", "submit": None, "": None, "cc by nc": None, "nothing of it": None}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", text.license_name(F.col("t")).alias("n"))
    assert {r.t: r.n for r in got.collect()} == said
    assert str(text.license_name(F.col("marker"))).count("marker") <= 3
