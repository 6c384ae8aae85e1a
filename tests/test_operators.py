"""Operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import filters, timecal
from chronoweave.operators import build, graph, search, timelines
from chronoweave.sources import pages
from chronoweave.streaming import limits, sync


def test_clamps_and_sanitizer():
    assert filters.clamp(500, 1, 50) == 50 and filters.clamp(0, 1, 25, 10) == 10 and filters.clamp(None, 1, 4) == 1
    assert filters.sanitize("a\x00b\tc\x7f\n") == "ab\tc\n" and filters.sanitize(None) is None


@pytest.mark.parametrize("text, hint, calendar, years", [("25,000 BBY – 19 BBY", "galactic", "galactic", [-25000, -19]), ("c. 4 aby", "auto", "galactic", [4]), ("May 23, 1959", "auto", "real", [1959]), ("long ago", "auto", "unknown", []), ("19 BBY", "real", "real", []), ("1959", "galactic", "galactic", [])])
def test_years(spark, text, hint, calendar, years):
    r = spark.createDataFrame([(text, hint)], "t string, h string").select(timecal.years(F.col("t"), F.col("h")).alias("x")).first().x
    assert (r.calendar, r.years) == (calendar, years)


def test_range_facets_and_buckets(spark):
    df = spark.createDataFrame([([],), ([4],), ([5, -3, 5],), ([1, 9, 3],)], "y array<int>")
    got = [[(x.role, x.year) for x in r.f] for r in df.select(timecal.range_facets(F.col("y")).alias("f")).collect()]
    assert got == [[("point", None)], [("point", 4)], [("start", -3), ("end", 5)], [("start", 1), ("mid", 3), ("end", 9)]]
    years = spark.createDataFrame([(y,) for y in (-23, -20, -1, 0, 1, 23)], "y int")
    assert [r.b for r in years.select(timecal.bucket(F.col("y"), 10).alias("b")).collect()] == [-30, -20, -10, 0, 0, 20]
    assert [r.d for r in years.select(timecal.mart_display(F.col("y")).alias("d")).collect()][3:5] == ["0 BBY", "1 ABY"]


def test_envelope_and_windows(spark):
    f = spark.createDataFrame([(1, "lifespan.start", 5, "a", 0), (1, "lifespan.start", 3, "b", 1), (1, "lifespan.end", 9, "c", 2), (1, "usage.point", None, "d", 3)], "id int, semantic string, year int, text string, pos int")
    assert tuple(timecal.envelope(f).first()) == (1, 3, 9, "a", "c")
    assert [(r.semantic, r.year, r.order) for r in timecal.facet_order(f).orderBy("semantic", "order").collect()] == [("lifespan.end", 9, 2), ("lifespan.start", 3, 0), ("lifespan.start", 5, 1), ("usage.point", None, 0)]
    e = spark.createDataFrame([(None, None), (1, None), (None, 5), (6, 9)], "from_year int, to_year int")
    assert e.where(filters.edge_window(2, 5)).count() == 3 and e.where(filters.active_at(7)).count() == 4


EDGES = "from_id long, to_id long, label string, reverse_label string, weight double, continuity string, from_year int, to_year int"


@pytest.fixture(scope="module")
def mini(spark):
    rows = [(1, 2, "a", "ra"), (2, 1, "a", "ra"), (2, 3, "a", "ra"), (3, 4, "a", "ra"), (4, 2, "a", "ra"), (1, 2, "b", ""), (5, 1, "b", "rb"), (3, 9, "b", "")]
    e = spark.createDataFrame([(*r, 0.5 + i / 10, "Canon", None, None) for i, r in enumerate(rows)], EDGES)
    for s in ("from", "to"):
        for c in ("name", "type", "realm"):
            e = e.withColumn(f"{s}_{c}", F.concat(F.lit(c), F.col(f"{s}_id").cast("string")))
    return e


def test_graph_on_cycles(spark, mini):
    pairs = {(r.id, r.ancestor): r.depth for r in graph.closure(mini, ["a"]).collect()}
    assert pairs == {(1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 1): 1, (2, 3): 1, (2, 4): 2, (3, 4): 1, (3, 2): 2, (3, 1): 3, (4, 2): 1, (4, 1): 2, (4, 3): 2}
    hops = [(r.hop, r.from_id, r.to_id) for r in graph.lineage(mini, 1, "a").collect()]
    assert hops == [(1, 1, 2), (2, 2, 1), (2, 2, 3), (3, 3, 4), (4, 4, 2)]
    nodes, merged = graph.neighbourhood(mini, 1, None, 1)
    assert {r.id: r.depth for r in nodes.collect()} == {1: 0, 2: 1, 5: 1}
    assert {(r.from_id, r.to_id): r.label for r in merged.collect()} == {(1, 2): "a / b", (2, 1): "a", (5, 1): "b"}
    assert graph.bidirectional(mini).count() == mini.count() + mini.where("reverse_label <> ''").count()
    path = [(r.from_id, r.to_id) for r in graph.connect(mini, 1, 4, 4).orderBy("step").collect()]
    assert path and path[0][0] == 1 and path[-1][1] == 4 and graph.connect(mini, 9, 5, 4).count() == 0


def test_infobox_edges(spark):
    rules = build.Rules(temporal={"Born": ("lifespan.start", "auto", False)}, relations={"Home": ("home_of", "", 1.0, ())})
    data = [("Born", ["19 BBY, Naboo"], [("Naboo", "https://x/wiki/Naboo")]), ("Home", ["Naboo (19 BBY–4 ABY)", "Prime Two"], [("naboo", "https://x/wiki/Naboo"), ("Prime", "https://x/wiki/P%2FQ"), ("Two", "https://x/wiki/none")]), ("Mass", ["4"], [])]
    box = ("https://x/wiki/Template:Person", None, data)
    p = spark.createDataFrame([(1, "Ann", "https://x/wiki/Ann", "Canon", box), (2, "Naboo", "https://x/wiki/Naboo", "Canon", None), (3, "P/Q", None, "Canon", None)], f"pageId long, title string, wikiUrl string, continuity string, infobox {build.INFOBOX}")
    f = build.fields(p, rules)
    assert {r.field: r.kind for r in f.collect()} == {"Born": "temporal", "Home": "relation", "Mass": "property"}
    assert [(r.semantic, r.year) for r in build.facets(f, rules).collect()] == [("lifespan.start", -19)]
    got = {(r.to_id, r.label, r.from_year, r.to_year, r.order) for r in build.edges(f, p, rules).collect()}
    assert got == {(2, "home_of", -19, 4, 0), (3, "home_of", None, None, 1)}
    names = spark.createDataFrame([("Affiliation(s)",), ("Home port",), ("DateOfBirth",), ("No",)], "l string")
    assert [r.x for r in names.select(build.snake_case(F.col("l")).alias("x")).collect()] == ["affiliation", "home_port", "date_of_birth", "no"]


def test_infobox_json():
    text = json.dumps([{"type": "group", "data": {"value": [{"type": "data", "data": {"label": "Home", "value": '<a href="/wiki/A">A</a><sup>1</sup>,<br>B.'}}]}}, {"type": "image", "data": [{"url": "u"}]}, {"type": "navigation", "data": {"value": '<a href="/wiki/Template:Planet?action=edit">e</a>'}}])
    box = pages.parse_infobox(text, "https://x")
    assert box["Template"] == "Template:Planet" and box["ImageUrl"] == "u"
    assert box["Data"] == [{"Label": "Home", "Values": ["A", "B"], "Links": [{"Content": "A", "Href": "https://x/wiki/A"}]}]
    assert pages.parse_infobox("{") is None and pages.parse_infobox(None) is None


def test_chunking():
    assert search.sections("") == [] and search.sections("# H1\ntext") == [("Introduction", "# H1\ntext")]
    assert [h for h, _ in search.sections("intro\n\n## A\na\n### B\nb\n## C\nc")] == ["Introduction", "A", "B", "C"]
    many = "\n\n".join("x" * 415 for _ in range(30))
    parts = search.paragraphs(many)
    assert len(parts) > 1 and all(100 <= len(p) <= search.MAX_CHARS for p in parts)
    assert len(search.chunk_text("y" * 8000)) == 1 and search.chunk_text("short") == []
    assert "data:image" not in search.chunk_text("a" * 200 + " [![x](data:image/png;base64,AA)](u) data:image/gif;base64,BB" + "\n" * 6 + "b" * 90)[0][1]


def test_embedding_and_hybrid(spark):
    df = spark.createDataFrame([(1, "t", "a" * 200), (2, "t", "b" * 150)], "id long, title string, text string")
    made = search.chunks(df, "id", "title", "text", embed=lambda xs: [[float("a" in x), 1.0] if "b" not in x else [0.0, 0.0] for x in xs])
    assert [(r.id, list(r.embedding)) for r in made.collect()] == [(1, [1.0, 1.0])]
    k = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    s = spark.createDataFrame([(1, 1.0), (1, 0.8), (3, 0.7)], "id long, score double")
    assert {r.id: (r.score, r.source) for r in search.hybrid(k, s).collect()} == {1: (1.0, "both"), 2: (0.5, "keyword"), 3: (0.7, "semantic")}


@pytest.mark.parametrize("text, want", [("L-9", (11, 8)), (" l - 9 ", (11, 8)), ("AA-1", None), ("L-0", None), ("L-21", None), ("L9", None)])
def test_grid(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(timelines.grid_square(F.col("t")).alias("s")).first().s
    assert (tuple(r) if r else None) == want


def test_rate_limit(spark, tmp_path):
    w = limits.Window(2, 10)
    assert [w.call(t)[0] for t in (0, 1, 2, 9, 10, 10.5, 11, 11.5)] == [True, True, False, False, False, True, False, True]
    assert all(limits.Window(0, 10).call(t)[0] for t in range(5))
    rows = [(i, i % 2, t) for i, t in enumerate((0, 0, 1, 1, 2, 2, 11, 11))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    want = [(r.event_id, r.allowed) for r in limits.sliding(df, 2, 10).orderBy("event_id").collect()]
    assert want == [(0, True), (1, True), (2, True), (3, True), (4, False), (5, False), (6, True), (7, True)]
    df.write.parquet(str(tmp_path / "in"))
    stream = limits.sliding_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 10)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r.event_id, r.allowed) for r in spark.table("limited").collect()) == want


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "")], "id int, t string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (3, "d")], "id int, t string")
    assert {r.id: r.t for r in build.merge_keeping(old, new, "id", ["t"]).collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.id: r.change for r in build.changed(new, old, "id", "t").collect()} == {1: "changed", 2: "changed", 3: "added"}
    rows, bad = build.import_lines(spark.createDataFrame([('{"a": 1}',), ("{x",)], "value string"), "a int")
    assert [r.a for r in rows.collect()] == [1] and bad.count() == 1


def test_incremental_sync(spark, tmp_path):
    schema, source, target = "id int, t string, at int", str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: sync.sync(spark, source, schema, "id", "at", target, str(tmp_path / "c"))
    kind = spark.createDataFrame([], schema).schema
    assert sync.latest(spark, target, kind).count() == 0
    put([(1, "a", 1), (2, "b", 1), (2, "c", 2)])
    run()
    put([(2, "d", 3), (3, "e", 3)])
    run()
    run()
    assert {r.id: r.t for r in sync.latest(spark, target, kind).collect()} == {1: "a", 2: "d", 3: "e"}


def test_sync_writes_what_a_batch_touches(spark, tmp_path):
    """A batch of two keys writes their parts and no other; one that runs again writes nothing; unused folders go."""
    target, schema = str(tmp_path / "out"), spark.createDataFrame([], "id long, t string, at int").schema
    rows = lambda ids, t, at: spark.createDataFrame([(i, t, at) for i in ids], schema)
    first = sync.put_batch(rows(range(500), "a", 1), 0, schema, "id", "at", target)
    assert len(first) == sync.PARTS
    held = sync.latest(spark, target, schema)
    second = sync.put_batch(rows([7, 600, 7], "b", 2), 1, schema, "id", "at", target)
    parts = {r.p for r in spark.createDataFrame([(7,), (600,)], "id long").selectExpr(f"string(pmod(xxhash64(id), {sync.PARTS})) AS p").collect()}
    assert set(second) == parts and sync.put_batch(rows([8], "c", 3), 1, schema, "id", "at", target) == []
    now = {r.id: r.t for r in sync.latest(spark, target, schema).collect()}
    assert now == {i: "b" if i in (7, 600) else "a" for i in [*range(500), 600]} and held.count() == 500
    sync.put_batch(rows(range(700), "d", 4), 2, schema, "id", "at", target)
    assert len(sync.clean(spark, target)) == 2 and {r.t for r in sync.latest(spark, target, schema).collect()} == {"d"}


def test_bundles(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([30, 20, 60, 10, 50])] + [("b", 0, 500), ("b", 1, 1)], "g string, i int, s int")
    from chronoweave.operators import pages as reads

    got = {(r.g, r.i): r.bundle for r in reads.bundles(rows, "g", ["i"], F.col("s"), 90).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 0): 0, ("b", 1): 1}


@pytest.mark.parametrize("html", ["<nav class=toc><ul><li>a<li>b</ul></nav><p>body</p>", "<footer class=navbox><table><tr><td>a<tr><td>b</table></footer><p>body</p>", "<div><aside class=noprint><p>a<p>b</div><p>body</p>", "<p class=toc>a<p>body</p>", "<form class='x ambox'><b>a</form><p>body</p>", "<nav id=toc>a<b></nav></b>body"])
def test_markdown_after_skipped_blocks(html):
    assert search.markdown(html) == "body"


def test_markdown_keeps_what_is_not_listed():
    """Only the listed classes go; other elements stay with their text, and of links those to wiki pages become absolute."""
    for tag in ("nav", "header", "footer", "aside", "form"):
        assert search.markdown(f"<{tag}>kept</{tag}><p>body</p>").split() == ["kept", "body"]
    assert search.markdown("<div class=reflist>kept</div>") == "kept"
    links = {"/wiki/A": "https://e.org/wiki/A", "mailto:a@b.c": "mailto:a@b.c", "#s": "#s", "//h/x": "//h/x", "y.html": "y.html", "/other": "/other", "https://o.org/wiki/B": "https://o.org/wiki/B"}
    for given, want in links.items():
        assert search.markdown(f'<a href="{given}">t</a>', "https://e.org") == f"[t]({want})"


def test_boilerplate_keeps_rows_with_images(spark, tmp_path):
    from chronoweave.plans.search_queries import boilerplate

    texts = {1: "a [![x](data:image/png;base64,AA)](u) b", 2: "see data:image/gif;base64,BB\n\n\n\nc ", 3: " plain\n\n\nd"}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.chars for r in boilerplate(spark, str(tmp_path)).collect()} == {1: len("a  b"), 2: len("see \n\nc"), 3: len("plain\n\nd")}


def test_bounds_need_a_start(spark):
    nodes = spark.createDataFrame([(1, -10, 5), (2, 0, None), (3, None, -50), (4, 20, 30), (5, None, None)], "id long, start_year int, end_year int")
    edges = spark.createDataFrame([(1, 2, None, None), (1, 3, None, 99), (1, 4, None, 7), (3, 5, None, 8), (1, 2, 3, 4), (2, 3, None, 9)], "from_id long, to_id long, from_year int, to_year int")
    got = sorted(((r.from_id, r.to_id, r.from_year, r.to_year) for r in graph.derive_bounds(edges, nodes).collect()), key=str)
    assert got == sorted([(1, 2, 0, 5), (1, 3, -10, 5), (1, 4, None, 7), (3, 5, None, 8), (1, 2, 3, 4), (2, 3, 0, None)], key=str)


def test_batches_by_walking(spark):
    for sizes, most_bytes, most_rows in (([150] * 3 + [1] * 3000, 150, 500), ([1] * 2000 + [10] * 200, 150, 500), ([7] * 40, 1000, 9)):
        rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "k long, line string")
        got = sorted((r.k, r.batch) for r in build.export_batches(rows, "k", "line", most_bytes, most_rows, 1).collect())
        want, part, lines, size = [], 0, 0, 0
        for n in sizes:
            if lines and (lines >= most_rows or size >= most_bytes):
                part, lines, size = part + 1, 0, 0
            lines, size = lines + 1, size + n
            want.append(f"0-{part}")
        assert [b for _, b in got] == want


def test_batches_of_small_and_large_inputs(spark):
    """Few rows are few full files; many are walked in many stretches, and no batch is over its caps by more than a line."""
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("x" * 10).alias("line"))
    assert build.export_batches(rows, "k", "line").select("batch").distinct().count() == 2
    many = build.export_batches(rows, "k", "line", 10**9, 20).groupBy("batch").count().collect()
    assert sum(r["count"] for r in many) == 1000 and max(r["count"] for r in many) == 20 and len(many) < 60 and len({r.batch.split("-")[0] for r in many}) > 1
    assert build.export_batches(rows.limit(0), "k", "line").count() == 0


def test_label_similarity(spark):
    labels = spark.createDataFrame([(x,) for x in ("employs", "employed_by", "in_nation", "in_region", "member_of", "members")], "label string")
    assert [(r.label, r.score) for r in build.label_similarity(labels, "in_nation").collect()] == [("in_nation", 1.0)]
    assert {r.label: r.score for r in build.label_similarity(labels, "member_by").collect()} == {"member_of": 0.7, "members": 0.7}
    assert build.label_similarity(labels, "employed").first().label == "employed_by"


def test_realm_marks(spark):
    rows = spark.createDataFrame([(["REAL-WORLD people"],), (["2004 releases"],), (["Canceled comics"],), (["comics"],), (["Own house rules"],), (None,)], "c array<string>")
    assert [r.x for r in rows.select(pages.realm(F.col("c"), "Made-up", ("house rules",)).alias("x")).collect()] == ["Real", "Real", "Real", "Made-up", "Real", "Made-up"]


def test_sections_with_odd_headings():
    assert search.sections("## A") == [("A", "## A")] and search.sections("a\n##") == [("Introduction", "a\n##")]
    assert search.sections("a\n## ") == [("Introduction", "a")] and search.sections("##\n\ntitle\nx") == [("title", "title\nx")]
    assert search.sections("##### five\n##no") == [("Introduction", "##### five\n##no")]


def test_paragraphs_by_their_properties():
    """Chunks are stretches of the text, in order, that end with a paragraph, begin with the end of the one before, leave nothing
    between them, and are cut only, and always, where the next paragraph would not fit."""
    import random

    rng, number = random.Random(5), iter(range(10**6))
    for _ in range(300):
        parts = [" ".join(f"w{next(number):06d}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 12))]
        most, least, overlap = rng.randrange(20, 200), rng.randrange(1, 30), rng.randrange(1, 30)
        text = "\n\n".join(parts)
        made = search.paragraphs(text, most, least, overlap)
        ends = [text.index(p) + len(p) for p in parts]
        places = [(text.index(c), text.index(c) + len(c)) for c in made]
        assert all(e in ends for _, e in places) and places == sorted(places) and (not places or places[0][0] == 0)
        assert len(text) < least if not places else places[-1][1] == ends[-1]
        begin, before = 0, 0
        for k, (start, end) in enumerate(places):
            assert text[begin:end].strip() == text[start:end]
            for e, following in zip(ends, ends[1:], strict=False):
                if before < e <= end:  # the first paragraph of a chunk is in it whatever its size
                    assert (e == end) == (e - begin > least and following - begin > most) or k + 1 == len(places) and following > end
            begin, before = end - overlap if end - begin > overlap else end + 2, end


def test_closure_of_a_long_chain_and_depth(spark):
    rows = [(i, i + 1) for i in range(37)] + [(5, 0), (10, 30)]
    e = spark.createDataFrame([(a, b, "a") for a, b in rows], "from_id long, to_id long, label string")
    best = {}
    for a in range(38):
        seen, front, d = {a}, {a}, 0
        while front:
            d, front = d + 1, {y for x, y in rows if x in front} - seen
            seen |= front
            best |= {(a, y): d for y in front}
    for depth in (None, 1, 5):
        got = {(r.id, r.ancestor): r.depth for r in graph.closure(e, ["a"], depth).collect()}
        assert got == {k: d for k, d in best.items() if depth is None or d <= depth}
