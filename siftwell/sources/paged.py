"""A data source over a paginated list service: one partition for each page of each code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: ``fetch(code, page, size)`` gives {"total": rows of the code, "rows": [dict, ...]}; pages count from 1.
Fetch = Callable[[int, int, int], dict]


class Page(InputPartition):
    """A page to fetch, or the rows of one that planning has fetched, and how many of its rows count."""

    def __init__(self, code: int, page: int, most: int, rows: list[dict] | None = None):
        self.code, self.page, self.most, self.rows = code, page, most, rows


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, names: list[str], codes: list[int], size: int, limit: int | None):
        self.fetch, self.names, self.codes, self.size, self.limit = fetch, names, codes, size, limit

    def partitions(self) -> list[Page]:
        """The first page of each code tells how many there are and travels with its partition, so no page is fetched twice."""
        found = []
        for code in self.codes:
            first = self.fetch(code, 1, self.size)
            rows = first.get("rows") or []
            most = min(first.get("total") or 0, self.limit or 1 << 62) if rows else 0
            for page in range(1, -(-most // self.size) + 1):
                found.append(Page(code, page, min(self.size, most - (page - 1) * self.size), rows if page == 1 else None))
        return found or [Page(0, 0, 0, [])]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = partition.rows if partition.rows is not None else self.fetch(partition.code, partition.page, self.size).get("rows") or []
        for row in rows[: partition.most]:
            yield tuple(partition.code if n == "code" else row.get(n) for n in self.names)


class FilteringReader(PagedReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Codes that a filter rules out are never asked for; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("code",):
                self.codes = [c for c in self.codes if c == f.value]
            elif isinstance(f, In) and f.attribute == ("code",):
                self.codes = [c for c in self.codes if c in f.value]
            else:
                yield f


def paged(spark: SparkSession, fetch: Fetch, schema: str, codes: list[int], size: int = 100, limit: int | None = None) -> DataFrame:
    """(code, columns of ``schema``) of all rows that the service lists under ``codes``, at most ``limit`` of each code.

    Planning asks for one page of each code; the others are fetched by tasks, each on its own, and a task that runs again
    fetches its page again. Filters on code reach the source where spark.sql.python.filterPushdown.enabled is on when this is called. Fields that a
    row lacks are null. ``fetch`` travels to the executors, so it brings its own connection, pace and retries.
    """

    columns = f"code int, {schema}"
    reading = FilteringReader if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else PagedReader

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "siftwell_paged"

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reading(fetch, schema.fieldNames(), list(codes), size, limit)

    spark.dataSource.register(Listing)
    return spark.read.format("siftwell_paged").load()
