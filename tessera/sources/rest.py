"""Paged REST collections as tables and as streams: spark.dataSource.register(RestPages), then format("rest_pages").

A collection answers GET url?offset=..&limit=.. with {"data": [...], "total": n}. A page is a partition, so pages are read side by side, each tried again on its own.
Filters go to the server where it takes them: columns named in the
option `equals` (column=parameter, comma-separated; parameter as the column if left out) as they are compared, and those in `since` (updatedAt=updatedSince, say) by
their lower bound; Spark applies all of them again, so
a server that ignores one changes no result. Filters need spark.sql.python.filterPushdown.enabled.

Options: path (the URL), fields (names, comma-separated: every value is text, nested ones as JSON), limit (rows of a page, 100), equals, since, mark (the column of a
stream's high-water mark), start (its first value), tries (3), seconds
(of a request, 30). A stream reads what has a mark from its last one on, up to the largest that the server has when the batch begins; rows at the last mark come again,
as the server may have got more of
them since, so drop repeats by key (unique_events, Store.advance).

Rows that come or go between two pages of one read can shift others across a page's edge; read on from a mark to get those."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

AGAIN = (429, 500, 502, 503, 504)


def _named(option: str | None) -> dict[str, str]:
    """column=parameter pairs of an option."""
    pairs = [p.strip().partition("=") for p in (option or "").split(",") if p.strip()]
    return {c: p or c for c, _, p in pairs}


class Collection:
    """One collection with the parameters that every request has."""

    def __init__(self, options: dict[str, str], parameters: dict[str, str] | None = None) -> None:
        self.url, self.limit = options["path"], int(options.get("limit", "100"))
        self.tries, self.seconds, self.parameters = int(options.get("tries", "3")), float(options.get("seconds", "30")), parameters or {}

    def get(self, offset: int, limit: int) -> dict:
        """A page; tried again where the server is busy or fails for now."""
        query = urllib.parse.urlencode(self.parameters | {"offset": offset, "limit": limit})
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(f"{self.url}?{query}", timeout=self.seconds) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or not left:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(0.2 * (self.tries - left))
        raise ValueError("tries must be 1 or more")

    def pages(self) -> list[int]:
        """Where each page begins; an empty collection has one, without rows."""
        return list(range(0, max(1, int(self.get(0, 1)["total"])), self.limit))

    def rows(self, offset: int) -> list[dict]:
        return self.get(offset, self.limit)["data"]


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True)


class Page(InputPartition):
    def __init__(self, offset: int, parameters: dict[str, str], after: str | None = None, upto: str | None = None) -> None:
        self.offset, self.parameters, self.after, self.upto = offset, parameters, after, upto


class RestPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> StructType:
        if not self.options.get("fields"):
            raise ValueError("rest_pages needs the option fields, or a schema of strings")
        return StructType([StructField(f.strip(), StringType()) for f in self.options["fields"].split(",")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(self.options, schema)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.names, self.parameters = dict(options), schema.names, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        equals, since = _named(self.options.get("equals")), _named(self.options.get("since"))
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo) and column in equals and f.value is not None:
                self.parameters[equals[column]] = str(f.value)
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and column in since:
                self.parameters[since[column]] = max(str(f.value), self.parameters.get(since[column], ""))
            yield f  # Spark applies it, too

    def partitions(self) -> list[Page]:
        return [Page(k, self.parameters) for k in Collection(self.options, self.parameters).pages()]

    def read(self, page: Page) -> Iterator[tuple]:
        for row in Collection(self.options, page.parameters).rows(page.offset):
            yield tuple(_text(row.get(n)) for n in self.names)


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.names = dict(options), schema.names
        self.mark = self.options["mark"]
        self.parameter = _named(self.options.get("since")).get(self.mark)
        self.last = self.options.get("start", "")

    def _from(self, mark: str) -> dict[str, str]:
        return {self.parameter: mark} if self.parameter and mark else {}

    def initialOffset(self) -> dict:
        return {"mark": self.options.get("start", "")}

    def latestOffset(self) -> dict:
        """The largest mark that the server has, of the rows since the last one: looked for page by page, as its order isn't known."""
        new = Collection(self.options, self._from(self.last))
        self.last = max((str(r[self.mark]) for k in new.pages() for r in new.rows(k) if r.get(self.mark) is not None), default=self.last)
        return {"mark": max(self.last, self.options.get("start", ""))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        parameters = self._from(start["mark"])
        return [Page(k, parameters, start["mark"], end["mark"]) for k in Collection(self.options, parameters).pages()]

    def read(self, page: Page) -> Iterator[tuple]:
        for row in Collection(self.options, page.parameters).rows(page.offset):
            if row.get(self.mark) is not None and page.after <= str(row[self.mark]) <= page.upto:
                yield tuple(_text(row.get(n)) for n in self.names)
