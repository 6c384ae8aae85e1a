"""A stream over a listing that is read page by page, each page telling the token of the next.

The stream's offset is the token of the next page and the number of pages before it, so Spark's own checkpoint is the saved
position: a query that starts again goes on at the page where it ended, and a batch that had begun is read again with
the same pages. Only the listing (ids and tokens) is walked by the driver, at most ``pages_per_batch`` pages for a batch; what the
ids stand for is fetched by the executors, a page a partition.

A listing that has come to its end stays there; what is new then needs a new listing, as a token can't be made up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Listing(Protocol):
    """What is paged through. It is sent to the executors, so it holds names and settings, no connections."""

    def page(self, token: str | None) -> tuple[list, str | None]:
        """The ids of a page (None: the first) and the next one's token, None at the end. The same token gives the same."""

    def fetch(self, ids: list) -> Iterator[tuple]:
        """The rows of ids."""


class Page(InputPartition):
    """Ids of one page."""

    def __init__(self, ids: list):
        self.ids = ids


class PageReader(DataSourceStreamReader):
    """Offsets: token (empty for the first page), pages (how many are before it), end (whether none follows)."""

    def __init__(self, listing: Listing, pages_per_batch: int):
        self.listing, self.most, self.at = listing, max(1, pages_per_batch), None

    def initialOffset(self) -> dict:
        return {"token": "", "pages": 0, "end": False}

    def _walk(self, start: dict, most: int) -> tuple[list[list], dict]:
        found, at = [], start
        while len(found) < most and not at["end"]:
            ids, token = self.listing.page(at["token"] or None)
            found.append(ids)
            at = {"token": token or "", "pages": at["pages"] + 1, "end": token is None}
        return found, at

    def latestOffset(self) -> dict:
        """The offset after the next batch. Where this reader has not planned any yet, a query begins: one that goes on has its
        last batch planned first."""
        self.at = self._walk(self.at or self.initialOffset(), self.most)[1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if self.at is None or self.at["pages"] < end["pages"]:
            self.at = end
        return [Page(ids) for ids in self._walk(start, end["pages"] - start["pages"])[0] if ids]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.listing.fetch(partition.ids)


def paged(spark: SparkSession, listing: Listing, schema: str, pages_per_batch: int = 10) -> DataFrame:
    """A stream of the listing's rows."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_listing"

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> PageReader:
            return PageReader(listing, pages_per_batch)

    spark.dataSource.register(Paged)
    return spark.readStream.format("paged_listing").load()


class FolderListing:
    """A listing kept as JSON files in a folder that all see: <token>.json with rows (id first) and next."""

    def __init__(self, uri: str, first: str = "0"):
        self.uri, self.first = uri, first

    def _read(self, token: str | None) -> dict:
        import json

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(f"{path}/{token or self.first}.json") as f:
            return json.loads(f.read())

    def page(self, token: str | None) -> tuple[list, str | None]:
        got = self._read(token)
        return [[token or self.first, i] for i in range(len(got["rows"]))], got["next"]

    def fetch(self, ids: list) -> Iterator[tuple]:
        rows = self._read(ids[0][0])["rows"]
        yield from (tuple(rows[i]) for _, i in ids)


class TableListing:
    """A listing kept as a Parquet table in folders page=<number>, from 0 to ``last``; a folder that is not there is an empty
    page. Rows are ordered by the first of ``columns``, which is their id."""

    def __init__(self, uri: str, last: int, columns: list[str]):
        self.uri, self.last, self.columns = uri, last, columns

    def _table(self, number: int, columns: list[str]):
        from pyarrow import dataset, fs

        store, path = fs.FileSystem.from_uri(f"{self.uri}/page={number}")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        return dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=columns).sort_by(columns[0])

    def page(self, token: str | None) -> tuple[list, str | None]:
        number = int(token or 0)
        ids = self._table(number, self.columns[:1])
        return [[number, i] for i in (ids.column(0).to_pylist() if ids else [])], str(number + 1) if number < self.last else None

    def fetch(self, ids: list) -> Iterator[tuple]:
        wanted = {i for _, i in ids}
        rows = self._table(ids[0][0], self.columns)
        yield from (r for r in zip(*(c.to_pylist() for c in rows.columns), strict=True) if r[0] in wanted)
