"""Regions, colours, categories, events of characters, reasons for no result and replacing sinks on small made-up rows."""

from pyspark.sql import functions as F

from chronoweave.operators import characters as C
from chronoweave.operators import galaxy as Y
from chronoweave.operators.build import INFOBOX
from chronoweave.sources import publish, sinks


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_regions(spark):
    assert [one(spark, x, Y.region_name) for x in (" mid RIM ", "the Outer Rim, far", "Core worlds of old", "elsewhere", None)] == ["Mid Rim", "Outer Rim Territories", "Core Worlds", None, None]
    assert [one(spark, x, Y.short_region) for x in ("Outer Rim Territories; Mid Rim", "the slice", "Bright Jewel, x", ";odd, x", " ;odd", ", outer rim territories", "", None)] == ["Outer Rim Territories", "The Slice", "Bright Jewel", ";odd, x", "", ", outer rim", "", None]


def test_categories_and_colours(spark):
    assert [one(spark, x, Y.category) for x in ("Duel", "Campaign", "Mission", "Feast", None)] == ["Battle", "War", "Campaign", "Event", "Event"]
    own = lambda c: Y.colour(c, {"Red Side": "#f00"})
    assert one(spark, "RED side", own) == "#f00"
    assert one(spark, "other", own) == one(spark, "OTHER", own) in Y.PALETTE


EVENT = "event_id long, type string, year double, demarcation string, date_text string, location string, description string, narrative string, significance string, source_title string, related array<string>, consequences array<string>"


def event(i, **given):
    names = [c.split()[0] for c in EVENT.split(", ")][1:]
    return (i, *[given.get(n) for n in names])


def test_consolidate(spark):
    rows = [
        event(1, type="Battle", year=22.0, demarcation="BBY", location="the Planet Ord"),
        event(2, type=" battle", year=22.5, demarcation="bby ", location="ord", narrative="n" * 101),
        event(3, type="Battle", year=23.0, demarcation="BBY", location="ord"),
        event(4, description="a" * 60 + "x"),
        event(5, type="Other", description="A" * 60 + "y", source_title="p"),
        event(6, description="b"),
        event(7, description="b"),
    ]
    got = C.consolidate(spark.createDataFrame(rows, EVENT))
    assert sorted(r.event_id for r in got.collect()) == [2, 3, 5, 6]
    assert C.consolidate(spark.createDataFrame([], EVENT)).count() == 0


def test_infer_years(spark):
    edges = spark.createDataFrame(
        [(1, 2, "fought_at", "Hero", "Ord ", None, -3), (1, 2, "saw", "Hero", "Ord ", -5, None), (3, 1, "taught", "Sage", "Hero", None, None), (9, 2, "at", "Other", "Ord", 7, None)],
        "from_id long, to_id long, label string, from_name string, to_name string, from_year int, to_year int",
    )
    nodes = spark.createDataFrame([(3, "Sage", None, 4), (2, "Ord", 99, None)], "id long, name string, start_year int, end_year int")
    events = spark.createDataFrame(
        [(1, 1, None, " ORD", ["Sage"]), (2, 1, None, None, ["none", "sage", "Ord"]), (3, 1, 5.0, "Ord", []), (4, 1, None, "far", None), (5, 8, None, "Ord", [])],
        "event_id long, character_id long, year double, location string, related array<string>",
    )
    got = {r.event_id: (r.year, r.demarcation, r.source) for r in C.infer_years(events, edges, nodes).collect()}
    assert got == {1: (5, "Bby", "kg-edge:saw→Ord "), 2: (4, "Aby", "kg-node:Sage")}


def test_why_empty(spark):
    pages = spark.createDataFrame([(1, ("x:Hero", None, [("Home", ["here"], [])]))], f"pageId long, infobox {INFOBOX}")
    pages = pages.withColumn("infobox", F.col("infobox").withField("Template", F.lit("Template:Hero")))
    assert C.why_empty(pages, "Hero", "home") == ("value", ["Home"])
    assert C.why_empty(pages, "Hero", "Age") == ("label", ["Home"])
    assert C.why_empty(pages, "hero", "Age") == ("case", ["Hero"])
    assert C.why_empty(pages, "Ship", "Age") == ("type", ["Hero"])


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, template string")
    sinks.replace_by(rows, "template", path)
    sinks.replace_by(rows.where("id = 2"), "template", path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "y")]
    sinks.replace_mart(rows, rows.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    sinks.replace_mart(rows.where("id = 1"), rows.agg(F.lit(1).alias("n")), str(tmp_path / "m"))
    mart = publish.current(spark, str(tmp_path / "m"))
    assert mart.table("rows").count() == 1
    assert mart.table("overview").first().n == 1
