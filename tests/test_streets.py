import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, streets


def run(spark, function, *texts):
    names = [f"c{i}" for i in range(len(texts))]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
    return df.select(function(*names).alias("v")).first()["v"]


@pytest.mark.parametrize("street, normal", [
    ("Jalan Setia U13/29B", "setia u13/29b"), ("JLN. Setia U13-12", "setia u13/12"), ("Lorong u13 12", "u13/12"),
    ("jalan jalan x", "jalan"), ("Setia A Utama B", "setia utama"), ("a  Besar", "besar"), (None, ""), ("", ""), ("Jalan", "jalan"),
    ("x a b yard", "b yard"), ("Persiaran\tSetia", "persiaran setia"),
])
def test_normal_form(spark, street, normal):
    assert run(spark, streets.normalize_street, street) == normal


@pytest.mark.parametrize("street, stem", [("jalan setia u13/29b", "jalan setia u13/29"), ("/29b", "/29b"), ("u13/29", "u13/29"), ("besar", "besar")])
def test_stem(spark, street, stem):
    assert run(spark, streets.street_stem, street) == stem


@pytest.mark.parametrize("street, expected", [
    ("Jalan U13/22B", ("U13", "22")), ("SS15/3D", ("SS15", "3")), ("Jalan SS2 Besar", ("SS2", None)), ("Jalan Besar", (None, None)),
])
def test_section(spark, street, expected):
    assert tuple(run(spark, streets.section_identifier, street)) == expected


@pytest.mark.parametrize("street, area, name", [
    ("Jalan Setia Nusantara U13/22T", None, "Setia Nusantara"), ("Jalan Nusantara U13/22T", None, "Nusantara"), ("Jalan U13/22", "Taman Sari", "Taman Sari"),
    ("Jalan U13/22", "Shah Alam", None), ("", "bukit raja", "Bukit Raja"), ("Jalan Bandar 12 Baru", "", None), ("Taman Utama U13 Besar", None, "Taman Utama"),
])
def test_development(spark, street, area, name):
    assert run(spark, streets.development_name, street, area) == name


@pytest.mark.parametrize("street, parts", [
    ("Jalan U13/52P", ("", "U13", "52p", "")), ("Jalan Setia U13/52P", ("setia", "U13", "52p", "")), ("Jalan Besar block b2", ("besar block b2", "", "", "b2")), ("jalan jalan", ("", "", "", "")),
])
def test_parts(spark, street, parts):
    assert tuple(run(spark, streets.street_parts, street)) == parts


@pytest.mark.parametrize("a, b, level", [
    ("Jalan Setia U13/5", "jln setia u13-5", "exact"), ("U13/55T", "U13/55Y", "stem"), ("Setia U13/1", "Setia U13/9", "development"),
    ("Setia U13/1", "U13/1", "section"), ("Setia U13/1", "Utama U13/1", None), ("Besar", "Kecil", None), ("", "Besar", None),
])
def test_match(spark, a, b, level):
    assert run(spark, streets.streets_match, a, b) == level


@pytest.mark.parametrize("street, name", [("Jalan Setia U13/29b", "Setia U13/29"), ("Jalan U13/29b", "U13/29"), ("jalan besar", "Besar"), ("ss15/3d", "S S15/3")])
def test_cluster_name(spark, street, name):
    assert run(spark, streets.cluster_name, street) == name


def test_small_text_functions(spark):
    assert run(spark, streets.title_case, "u13/29b setia o'neil") == "U13/29B Setia O'Neil"
    assert run(spark, streets.display_stem, "Jalan Setia Indah U13/9W") == "Jalan Setia Indah"
    assert run(spark, streets.display_stem, "Persiaran Setia Wawasan") == "Persiaran Setia Wawasan"
    assert run(spark, streets.name_to_development, "Setia Indah U13/9") == "Setia Indah"
    assert run(spark, streets.name_to_development, "Setia Indah") == "Setia Indah"
    assert run(spark, streets.clean_street, "A Jalan B Setia C U13/52P D") == "Jalan Setia U13/52P"
    assert tuple(run(spark, streets.address_choice, "", "Besar")) == ("Besar", "reference", False)
    assert tuple(run(spark, streets.address_choice, None, "")) == (None, "suggestion", True)
    assert run(spark, geo.address_line, "Jalan X", "40000", "") == "Jalan X, 40000"
    assert run(spark, geo.address_line, None, None, None) == ""


def test_roads_and_distances(spark):
    df = spark.createDataFrame([("primary", "3.0"), ("path", "x"), (None, None), ("moon", "3.1")], "h string, lat string")
    rows = df.select(geo.road_level("h"), geo.is_main_road("h"), geo.haversine_km("lat", F.lit("101.0"), F.lit(3.0), F.lit(101.0))).collect()
    assert [(r[0], r[1]) for r in rows] == [(3, True), (10, False), (6, False), (9, False)]
    assert [round(r[2], 3) for r in rows] == [0.0, 0.0, 0.0, 11.119]


def test_sql_functions_agree_with_columns(spark):
    from waymark.functions.sql import register_functions

    assert "haversine_km" in register_functions(spark)
    df = spark.createDataFrame([(3.0, 101.0, 3.1, 101.2, "u13/29b"), (None, 101.0, 3.1, 101.2, "besar")], "a double, b double, c double, d double, s string")
    df.createOrReplaceTempView("pairs_for_functions")
    sql = "select round(haversine_km(a, b, c, d), 9), near_equal(a, b, c, d, 0.5D), round(degree_distance(a, b, c, d), 9), coord_key(c, d), leg_key(c, d, c, d), street_stem(s) from pairs_for_functions"
    columns = df.select(
        F.round(geo.haversine_km("a", "b", "c", "d"), 9), geo.near_equal("a", "b", "c", "d", 0.5), F.round(geo.degree_distance("a", "b", "c", "d"), 9),
        geo.coord_key("c", "d"), geo.leg_key("c", "d", "c", "d"), streets.street_stem("s"),
    )
    assert [tuple(r) for r in spark.sql(sql).collect()] == [tuple(r) for r in columns.collect()]


TEXTS = [
    "Jalan Setia U13/29B", "jln. Taman Utama U1-12", "Lorong Bandar A Baru 5/7a", "Persiaran Besar", " U13 12 ", "taman", "Jalan Setia Indah U13/9 blk", "Block 7 Kota X/1", "", None, "a", "Jalan A b U5/6c d",
    "SETIA ALAM", "Desa 12 jalan", "Jalan Ara Damansara PJU1A/2 C", "x  y  z", "U13/52P Q", "Kota Setia Block b2 u9/10", "Jalan 5/", "l'Été-d'or / 5",
]


def test_sql_functions_of_streets_agree_with_columns(spark):
    from waymark.functions.sql import register_functions

    register_functions(spark)
    rows = [(i, a, TEXTS[(i * 7 + 3) % len(TEXTS)]) for i, a in enumerate(TEXTS)] + [(100 + i, a, a) for i, a in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df.createOrReplaceTempView("streets_for_functions")
    one = ["normalize_street", "street_stem", "title_case", "section_identifier", "clean_street", "street_parts", "cluster_name", "display_stem", "name_to_development"]
    two = ["development_name", "streets_match", "address_choice"]
    asked = ", ".join([f"{n}(a) as {n}" for n in one] + [f"{n}(a, b) as {n}" for n in two])
    got = spark.sql(f"select {asked} from streets_for_functions order by i").collect()
    want = df.orderBy("i").select(*[getattr(streets, n)("a").alias(n) for n in one], *[getattr(streets, n)("a", "b").alias(n) for n in two]).collect()
    for g, w, (_, a, b) in zip(got, want, rows, strict=True):
        assert g.asDict(True) == w.asDict(True), (a, b)


def test_sql_functions_of_roads_and_times_agree_with_columns(spark):
    from waymark.functions import payload
    from waymark.functions.sql import register_functions

    register_functions(spark)
    rows = [("primary", "private", None, 3, 4, "2024-01-02 03:04:05", "Jalan X", None), (None, None, "no", 1, 40, "2024-01-02 03:04:05.25", "", "40000"), ("moon", "yes", "yes", 9, 9, None, None, "")]
    df = spark.createDataFrame(rows, "h string, x string, y string, n bigint, m bigint, t string, s string, p string").selectExpr("*", "cast(t as timestamp) as ts", "timestamp'2024-02-01' as now", "array(array(n * 1D, m * 1D)) as ps")
    df.createOrReplaceTempView("roads_for_functions")
    got = spark.sql(
        "select road_level(h), is_main_road(h), is_residential(h), restricted_access(x, y, x), crossing_confidence(n, m), age_seconds(now, ts), iso_text(ts), blank_to_null(s), address_line(s, p, h), swap_axes(ps), "
        "int_metres(n / 7), metres_to_degrees(m), in_box(n, m, 2, 5, 1.5), degree_distance_sq(n, m, 1, 2) from roads_for_functions"
    ).collect()
    lit = F.lit
    want = df.select(
        geo.road_level("h"), geo.is_main_road("h"), geo.is_residential("h"), geo.restricted_access("x", "y", "x"), geo.crossing_confidence("n", "m"), payload.age_seconds("now", "ts"), payload.iso_text("ts"), payload.blank_to_null("s"),
        geo.address_line("s", "p", "h"), geo.swap_axes("ps"), geo.int_metres(F.col("n") / 7), F.col("m") / 111000, geo.in_box("n", "m", lit(2.0), lit(5.0), 1.5), geo.degree_distance_sq("n", "m", lit(1.0), lit(2.0)),
    ).collect()
    assert [tuple(g) for g in got] == [tuple(w) for w in want]
