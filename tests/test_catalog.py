"""Names, paths and sizes: closed forms."""

import pytest
from pyspark.sql import functions as F

from texloom.functions import catalog as C


def values(spark, f, args):
    return [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(args)], "i int, a string").orderBy("i").select(f(F.col("a"))).collect()]


@pytest.mark.parametrize("name, kind", [
    ("brick_diff.png", "diffuse"), ("a/b_NORMAL.tga", "normal"), ("x_n.png", "normal"), ("x_basecolor.png", "diffuse"), ("x_ambientocclusion.png", "ao"), ("x.png", "unknown"),
    ("rough.png", "unknown"), ("x_gloss.dds", "roughness"), ("v1.2_orm.png", "orm"), ("x_c", "diffuse"), ("icons_icon.png", "ui"),
])
def test_texture_type(spark, name, kind):
    assert values(spark, C.texture_type, [name]) == [kind]


def test_words_stand_alone(spark):
    names = ["ironsword", "iron_sword", "a/iron-plate", "cobblestone", "stone2", "my_cobblestone_wall", "Gold.png", ""]
    assert values(spark, C.material, names) == ["default", "iron", "iron", "cobblestone", "stone", "cobblestone", "gold", "default"]
    assert values(spark, C.is_hero, ["heroic", "hero_1", "surface"]) == [False, True, False]


def test_paths(spark):
    names = ["a\\b/./c.png", "a/../b.png", "../x", "/abs", "C:/x", "//u/x", "", ".", "a/b/../../c", None]
    assert values(spark, C.normal_path, names) == ["a/b/c.png", "b.png", None, None, None, None, None, None, "c", None]


def test_suffixes_and_tags(spark):
    assert values(spark, C.map_suffix, ["base", "_base", " ", None, "Normal", "_AO"]) == ["", "", "", "", "_normal", "_ao"]
    assert values(spark, C.safe_tag, ["a b-c", "__x__"]) == ["a_b_c", "x"]


def test_powers_and_sizes(spark):
    n = F.col("a").cast("int")
    assert values(spark, lambda a: C.nearest_power(a.cast("int")), ["1", "2", "3", "4", "5", "6", "1536", "1024", "2048"]) == [1, 2, 4, 4, 4, 8, 2048, 1024, 2048]
    assert values(spark, lambda a: C.human_bytes(a.cast("long")), ["-1", "0", "1023", "1536", str(5 << 30)]) == ["n/a", "0 B", "1023 B", "1.50 KiB", "5.00 GiB"]
    del n


def _same_as_sql(spark, folder, name, rows):
    """A query and its SQL on parts of large keys, where the largest unit is reached."""
    import duckdb

    from texloom.plans.all import QUERIES, SQL

    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, CAST(s AS INT) AS p_size FROM (VALUES {', '.join(map(str, rows))}) v(k, s)) TO '{folder}/part.parquet'")
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    mine, theirs = QUERIES[name](spark, str(folder)).collect(), duck.execute(SQL[name]).fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs)
    return [r[1] for r in sorted(theirs)]


def test_human_sizes_beyond_a_tebibyte_are_those_of_the_sql(spark, tmp_path):
    found = _same_as_sql(spark, tmp_path, "human_sizes", [(3, 7), (900, 40), (20_000, 50), (148_398, 50), (1_199_999, 50)])
    assert found[3] == "1025.48 GiB" and found[4].endswith(" GiB")


def test_size_changes_beyond_a_gibibyte_are_those_of_the_sql(spark, tmp_path):
    found = _same_as_sql(spark, tmp_path, "size_changes", [(3, 7), (20_000, 50), (580_417, 50), (1_199_999, 1), (1_199_999, 50), (1_199_985, 9)])
    assert found[2] == "size=553.53 MiB->1024.03 MiB (+470.50 MiB, +85.0%)" and " GiB" not in "".join(found)


def test_size_change_goes_up_to_the_unit_asked_for(spark):
    text = lambda *u: values(spark, lambda a: C.size_change(F.lit(1 << 20), a.cast("long"), *u), [str(5 << 30)])
    assert text() == ["size=1.00 MiB->5.00 GiB (+5.00 GiB, +511900.0%)"]
    assert text("MiB") == ["size=1.00 MiB->5120.00 MiB (+5119.00 MiB, +511900.0%)"]


@pytest.mark.parametrize("largest, want", [("KiB", "5242880.00 KiB"), ("MiB", "5120.00 MiB"), ("GiB", "5.00 GiB"), ("TiB", "5.00 GiB")])
def test_largest_unit(spark, largest, want):
    assert values(spark, lambda a: C.human_bytes(a.cast("long"), largest), [str(5 << 30), "1023"]) == [want, "1023 B"]


@pytest.mark.parametrize("h, w, res, want", [(768, 1024, 2048, (1536, 2048)), (512, 1024, 2048, (1024, 2048)), (100, 60, 256, (256, 154))])
def test_target_size(spark, h, w, res, want):
    r = spark.range(1).select(C.target_size(F.lit(h), F.lit(w), res).alias("t")).first()["t"]
    assert (r["h"], r["w"]) == want


@pytest.mark.parametrize("h, w", [(768, 1024), (100, 60), (5, 500), (64, 64), (3, 1000)])
def test_target_size_in_powers_keeps_the_ratio_best(spark, h, w):
    r = spark.range(1).select(C.target_size(F.lit(h), F.lit(w), 2048, powers=True).alias("t")).first()["t"]
    small, big = sorted((r["h"], r["w"]))
    assert big == 2048 and small & (small - 1) == 0
    ratio = max(h, w) / min(h, w)
    assert abs(big / small - ratio) <= min(abs(big / s - ratio) for s in (max(1, small // 2), min(4096, small * 2))) + 1e-9
