"""Queries that SQL can't say against plain walks over the same rows."""

from collections import deque

from chronoweave.plans import catalog


def test_rate_limiter(spark, small):
    """Three calls a day for each user; a refused call does not count."""
    want, passed = {}, {}
    for r in sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        own = passed.setdefault(r.user_id, deque())
        while own and (r.ts - own[0]).total_seconds() > 86_400:
            own.popleft()
        want[r.event_id] = len(own) < 3
        if want[r.event_id]:
            own.append(r.ts)
    assert {r.event_id: r.allowed for r in catalog.QUERIES["rate_limiter"](spark, small).collect()} == want and len(set(want.values())) == 2


def test_page_bundles(spark, small):
    want, own, bundle, total = {}, None, 0, 0
    for r in sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: (r.source, r.doc_id)):
        if r.source != own:
            own, bundle, total = r.source, 0, 0
        elif total and total + len(r.text) > 40_000:
            bundle, total = bundle + 1, 0
        total += len(r.text)
        want[r.doc_id] = bundle
    assert {r.doc_id: r.bundle for r in catalog.QUERIES["page_bundles"](spark, small).collect()} == want and max(want.values()) > 0


def test_batch_export(spark, small):
    """Every document once; each batch but a stretch's last is full by lines or by bytes, and none is over."""
    batches = {r.batch: r for r in catalog.QUERIES["batch_export"](spark, small).collect()}
    assert sum(r.lines for r in batches.values()) == spark.read.parquet(f"{small}/documents.parquet").count()
    for name, r in batches.items():
        stretch, part = name.split("-")
        full = r.lines == 20 or r.bytes >= 100_000
        assert r.lines <= 20 and (full or f"{stretch}-{int(part) + 1}" not in batches)
