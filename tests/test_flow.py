"""Crawl states, rates, discovery and extraction, the graph around a root: against walks by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import analytics as A
from chronoweave.operators import discovery, graph
from chronoweave.streaming import crawl

T0 = dt.datetime(2024, 1, 1)


def log(rng, pages, n, step=240):
    at, out = T0, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.randrange(1, step))
        out.append((rng.randrange(pages), at, i, rng.choice(["claim", "claim", "done", "failed", "skipped", "release", "what"]), rng.randrange(3)))
    return out


def by_hand(events, lease=dt.timedelta(minutes=10)):
    """page -> changes, by an own walk over the sorted log."""
    state, out = {}, []
    for page, at, _, kind, batch in sorted(events, key=lambda e: (e[1], e[2])):
        status, own, since = state.get(page, ("Pending", None, None))
        if status == "Processing" and at - since > lease:
            out.append((page, "Pending", own, since + lease, "stale"))
            status = "Pending"
        holds = status == "Processing" and own == batch
        after = {"claim": "Processing" if status == "Pending" else None, "done": "Completed" if holds else None, "failed": "Failed" if holds else None, "skipped": "Skipped" if holds else None, "release": "Pending" if holds else None}.get(kind)
        if after:
            out.append((page, after, batch, at, kind))
            status, own, since = after, batch, at if kind == "claim" else since
        state[page] = (status, own, since)
    return out, state


KIND = "page long, at timestamp, event long, kind string, batch long"


def test_crawl_replay(spark):
    events = log(random.Random(1), 60, 2500, 12)
    df = spark.createDataFrame([*events, (None, T0, 1, "claim", 1), (1, None, 2, "claim", 1), (1, T0, 3, None, 1)], KIND).repartition(5)
    changes = crawl.replay(df)
    got = sorted((r.page, r.at, r.status, r.batch, r.why) for r in changes.collect())
    want, state = by_hand(events)
    micros = lambda t: int((t - T0).total_seconds() * 1e6) + int(T0.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    assert got == sorted((p, micros(t), s, b, w) for p, s, b, t, w in want)
    assert {w for *_, w in got} == {"claim", "done", "failed", "skipped", "release", "stale"}
    end = max(e[1] for e in events) + dt.timedelta(minutes=5)
    last = {r.page: r.status for r in crawl.final(changes, F.lit(str(end)).cast("timestamp")).collect()}
    assert last == {p: "Pending" if s == "Processing" and end - since > dt.timedelta(minutes=10) else s for p, (s, _, since) in state.items()}


def test_a_batch_that_ends_in_part(spark):
    """Of five pages of a batch two tell their results before it is released; a page claimed anew by another batch is left alone."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    events = [(p, at(0), p, "claim", 7) for p in range(5)] + [(0, at(1), 10, "done", 7), (1, at(1), 11, "failed", 7), (4, at(2), 12, "release", 7), (4, at(3), 13, "claim", 8), (None, at(4), 20, "release", 7), (2, at(5), 21, "done", 7)]
    members = spark.createDataFrame([(7, p) for p in range(5)], "batch long, page long")
    changes = crawl.replay(crawl.for_pages(spark.createDataFrame(events, KIND), members))
    assert {r.page: (r.status, r.batch) for r in crawl.final(changes, F.lit(str(at(6))).cast("timestamp")).collect()} == {0: ("Completed", 7), 1: ("Failed", 7), 2: ("Pending", 7), 3: ("Pending", 7), 4: ("Processing", 8)}


def test_crawl_stream(spark, tmp_path):
    """The log in three files, and then one event that lets the watermark pass the last leases."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = log(random.Random(3), 6, 90)
        parts = [events[:30], events[30:60], events[60:], [(99, events[-1][1] + dt.timedelta(hours=2), 999, "claim", 1)], [(98, events[-1][1] + dt.timedelta(hours=2), 1000, "claim", 1)]]
        source, out = str(tmp_path / "log"), str(tmp_path / "out")
        for part in parts:
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
            changes = crawl.stream(spark.readStream.schema(KIND).parquet(source))
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.page, r.at, r.status, r.batch, r.why) for r in spark.read.parquet(out).where("page < 98").collect())
        want = crawl.replay(spark.createDataFrame([*events, *[(p, events[-1][1] + dt.timedelta(hours=2), 2000 + p, "what", 1) for p in range(6)]], KIND))
        assert got == sorted((r.page, r.at, r.status, r.batch, r.why) for r in want.collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rates(spark):
    now, at = F.lit(str(T0)).cast("timestamp"), lambda h: T0 - dt.timedelta(hours=h)
    pages = spark.createDataFrame([(i, "A" if i < 6 else None) for i in range(10)], "page long, type string")
    chunks = spark.createDataFrame([(0, at(0.5)), (0, at(3)), (1, at(1)), (2, at(1.01)), (7, at(0.1)), (7, at(0.2)), (55, at(0.1)), (3, at(-1))], "page long, created_at timestamp")
    got = {r.type: tuple(r)[1:] for r in A.chunk_rates(pages, chunks, now).collect()}
    assert got == {"A": (6, 4, 2, 5, 1.3, 2, 1.0), "Unknown": (4, 1, 3, 2, 2.0, 1, 3.0), None: (10, 5, 5, 7, 1.4, 3, 1.7)}
    assert {r.hours_left for r in A.chunk_rates(pages, chunks.where("page = 2"), now).collect()} == {None}
    states = spark.createDataFrame([(0, "Completed"), (1, "Skipped"), (2, "Processing"), (6, "Failed")], "page long, status string")
    batches = spark.createDataFrame([(at(4), at(2), "Processed", 5, 1), (at(2), at(1), "Processed", 2, 0), (at(50), at(30), "Processed", 900, 0), (at(9), None, "Failed", 7, 7)], "created_at timestamp, processed_at timestamp, status string, completed int, skipped int")
    got = {r.type: tuple(r)[1:] for r in A.builder_rates(pages, states, batches, now).collect()}
    assert got == {"A": (6, 1, 1, 0, 4, 2.0, 2.0), "Unknown": (4, 0, 0, 1, 3, 2.0, 1.5), None: (10, 1, 1, 1, 7, 2.0, 3.5)}
    assert {(r.per_hour, r.hours_left) for r in A.builder_rates(pages, states, batches.limit(0), now).collect()} == {(0.0, None)}


def around(nodes, edges, root, depth, cap, per_hop, labels=None, realm=None):
    """By the statement of query_graph, on plain lists."""
    weight = lambda e: 0.8 if e["weight"] is None else e["weight"]
    key = lambda e: (-weight(e), e["from_id"], e["to_id"], e["label"])
    seen, front, found = {root: 0}, {root}, {}
    for hop in range(1, depth + 1):
        far = lambda e, side: realm is None or e[side] in (None, realm, "Unknown")
        went = sorted((e for e in edges if e["from_id"] in front and far(e, "to_realm") and (not labels or e["label"] in labels)), key=key)[:per_hop]
        came = sorted((e for e in edges if e["to_id"] in front and far(e, "from_realm") and (not labels or e["label"] in labels or e["reverse_label"] in labels)), key=key)[:per_hop]
        steps = [(e["from_id"], e["to_id"], e["label"], e) for e in went] + [(e["to_id"], e["from_id"], e["reverse_label"] or e["label"], e) for e in came if e["from_id"] not in front]
        for a, b, label, e in steps:
            found.setdefault((a, b, label), e)
        new = sorted({b for _, b, _, _ in steps} - set(seen))
        front = set(new[: cap - len(seen)])
        seen |= dict.fromkeys(front, hop)
        if len(front) < len(new) or not front:
            return seen, found, len(front) < len(new)
    return seen, found, False


@pytest.mark.parametrize("depth, cap, per_hop, labels, realm", [(1, 1000, 500, None, None), (2, 1000, 500, None, None), (3, 1000, 500, None, None), (4, 1000, 500, None, None), (3, 25, 500, None, None), (4, 1000, 5, None, None), (3, 1000, 500, ["knows", "owned_by"], None), (4, 1000, 500, None, "Fiction")])
def test_graph_around_a_root(spark, depth, cap, per_hop, labels, realm):
    rng = random.Random(7)
    realms = {i: rng.choice(["Fiction", "Fiction", "Real", "Unknown"]) for i in range(90)}
    realms[0] = "Fiction"
    rows = []
    for _ in range(170):
        a, b, label = rng.randrange(90), rng.randrange(90), rng.choice(["knows", "owns", "part_of"])
        rows.append({"from_id": a, "to_id": b, "label": label, "reverse_label": {"knows": "knows", "owns": "owned_by", "part_of": ""}[label], "weight": rng.choice([None, 0.5, 0.9, 1.0]), "continuity": "Canon", "from_year": rng.choice([None, 3]), "to_year": None, "from_name": f"n{a}", "to_name": f"n{b}", "from_realm": rng.choice([None, realms[a]]), "to_realm": realms[b]})
    rows = list({(r["from_id"], r["to_id"], r["label"]): r for r in rows}.values())
    edges = spark.createDataFrame([tuple(r.values()) for r in rows], "from_id long, to_id long, label string, reverse_label string, weight double, continuity string, from_year int, to_year int, from_name string, to_name string, from_realm string, to_realm string")
    nodes = spark.createDataFrame([(i, f"N{i}", "T", realms[i]) for i in range(80)], "id long, name string, type string, realm string")
    got = graph.query_graph(nodes, edges, 0, labels, depth, max_nodes=cap, per_hop=per_hop, realm=realm)
    seen, found, truncated = around(nodes, rows, 0, depth, cap, per_hop, labels, realm)
    assert {(r.id, r.depth, r.name, r.type) for r in got.nodes.collect()} == {(i, d, f"N{i}" if i < 80 else f"n{i}", "T" if i < 80 else "") for i, d in seen.items()}
    pairs = {}
    for (a, b, label), e in found.items():
        if a in seen and b in seen:
            pairs.setdefault((a, b), []).append((label, 0.8 if e["weight"] is None else e["weight"]))
    assert {(r.from_id, r.to_id): (r.label, r.weight) for r in got.edges.collect()} == {k: (" / ".join(sorted({x for x, _ in v})), max(w for _, w in v)) for k, v in pairs.items()}
    assert got.truncated == truncated and (cap != 25 or truncated)
    if depth == 1:
        assert len(graph.query_graph(nodes, edges, 0, only_root=True).nodes.collect()) == 1
        assert graph.query_graph(nodes, edges, 85, only_root=True).nodes.count() == 0
        for wanted, n in (("Real", 0), ("Fiction", 1)):
            assert graph.query_graph(nodes, edges, 0, realm=wanted, only_root=True).nodes.count() == n
        assert graph.query_graph(nodes, edges, 0, realm="Real").nodes.count() == 0
        alone = graph.query_graph(nodes, edges, 12345)
        assert [tuple(r) for r in alone.nodes.collect()] == [(12345, "#12345", "", 0)] and alone.edges.count() == 0


def test_waypoints_may_be_their_own_place(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 3)], "from_id long, to_id long")
    located = spark.createDataFrame([(3,), (1,)], "id long")
    starts = spark.createDataFrame([(1,), (2,), (4,), (7,)], "id long")
    got = {tuple(r) for r in graph.nearest_location(edges, located, starts, 2, start_counts=True).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (4, 3, 1)}


def test_discovery(spark):
    """A root with more links and edges than the limits, whose pages are found in several ways."""
    rng = random.Random(5)
    kinds = ["Canon", "Legends", "Both", "Unknown", None]
    pages = [(i, f"u{i}", kinds[i % 5] if i else "Canon", f"text {i}") for i in range(300)]
    links = [(i, "u0") for i in range(1, 200, 2)] + [(0, f"u{i}") for i in range(1, 120, 3)] + [(0, "u7"), (0, ""), (0, None), (0, "elsewhere"), (0, "u0"), (2, "u1")]
    edges = [(0, i, rng.choice([0.5, 0.8, 1.0]), rng.choice(kinds[:4])) for i in range(60, 299)] + [(0, 0, 1.0, "Canon"), (0, 5000, 1.0, "Canon"), (2, 3, 1.0, "Legends")]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = discovery.discover(df([(0,), (2,), (777,)], "id long"), df(pages, "id long, url string, continuity string, text string"), df(links, "id long, href string"), df(edges, "from_id long, to_id long, weight double, continuity string"))
    found = {(r.root, r.page): r.how for r in got.collect()}
    fits = lambda c: c in ("Canon", "Both", "Unknown", None)
    want = {0: "self"}
    for i in sorted(i for i, h in links if h == "u0" and i and fits(pages[i][2]))[:20]:
        want.setdefault(i, "incoming")
    for i in sorted({int(h[1:]) for p, h in links if p == 0 and h and h[0] == "u" and h != "u0"} & {i for i, _, c, _ in pages if fits(c)})[:20]:
        want.setdefault(i, "outgoing")
    for _, i, _, _ in sorted((e for e in edges if e[0] == 0 and fits(e[3])), key=lambda e: (-e[2], e[1]))[:40]:
        if 0 < i < 300:
            want.setdefault(i, "graph")
    assert {p: h for (r, p), h in found.items() if r == 0} == want and set(want.values()) == {"self", "incoming", "outgoing", "graph"}
    assert {p: h for (r, p), h in found.items() if r == 2} == {2: "self", 1: "outgoing", 3: "graph"} and not [k for k in found if k[0] == 777]


def test_contents(spark):
    pages = spark.createDataFrame([(1, "t1", "plain" * 2000, "u1", "Canon"), (2, "t2", "x", "u2", None), (3, "t3", None, "u3", "Both")], "id long, title string, text string, url string, continuity string")
    chunks = spark.createDataFrame([(2, i, "Head" if i % 2 else " ", f"chunk {i} " + "y" * 3000) for i in range(6)], "id long, chunk_index int, heading string, text string")
    got = {r.id: r.content for r in discovery.contents(pages, chunks).collect()}
    whole = "".join(("## Head\n" if i % 2 else "") + f"chunk {i} " + "y" * 3000 + "\n\n" for i in range(6))
    assert got == {1: ("plain" * 2000)[:4000], 2: whole[:8000], 3: ""}
    links = spark.createDataFrame([(1, f"u{k}") for k in (3, 2, 2)] + [(1, " "), (3, "gone")], "id long, href string")
    edges = spark.createDataFrame([(1, 9, "b", 0.5), (1, 8, "a", 1.0)], "from_id long, to_id long, label string, weight double")
    got = {r.id: r for r in discovery.page_content(pages, links, edges).collect()}
    assert got[1].content == ("plain" * 2000)[:8000] + "\n... [truncated]" and [x.id for x in got[1].linked] == [2, 3] and [x.label for x in got[1].edges] == ["a", "b"]
    assert got[2].content == "x" and got[2].linked is None and got[3].content == "" and got[3].linked is None


def test_extraction_parts_errors(spark):
    """Of four batches one raises and one gives what does not fit; the others are delivered."""
    rows = spark.createDataFrame([(b, k, f"{b}-{k}") for b in range(4) for k in range(3)], "batch long, page long, prompt string").repartition(3)

    def fake(prompts):
        if prompts[0]["batch"] == 2:
            raise OSError("no answer")
        if prompts[0]["batch"] == 3:
            return [{"year": 1}]
        return [{"year": p["page"], "said": ",".join(x["prompt"] for x in prompts)} for p in prompts if p["page"]]

    events, errors = discovery.extract(rows, ["batch"], ["page"], fake, "year long, said string")
    assert sorted(map(tuple, events.collect())) == [(b, k, ",".join(f"{b}-{i}" for i in range(3))) for b in range(2) for k in (1, 2)]
    got = {r.batch: (r.rows, r.error) for r in errors.collect()}
    assert set(got) == {2, 3} and got[2] == (3, "OSError: no answer") and "KeyError" in got[3][1]
