"""The paginated source over a local table of pages, whose visits are counted."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwell.sources.paged import paged

TOTAL = {1: 23, 2: 0, 3: 10, 4: 1}


@pytest.fixture
def service(tmp_path):
    table, visits = tmp_path / "table.json", tmp_path / "visits"
    visits.mkdir()
    table.write_text(json.dumps({str(c): [{"bbbs": f"{c}-{i}", "title": f"law {i}", "sxx": i % 4 if i % 5 else None} for i in range(n)] for c, n in TOTAL.items()}))

    def fetch(code, page, size):
        import uuid

        (visits / f"{code}.{page}.{uuid.uuid4().hex}").touch()
        rows = json.loads(Path(table).read_text())[str(code)]
        return {"total": len(rows), "rows": rows[(page - 1) * size : page * size]}

    return fetch, lambda: sorted(tuple(map(int, p.name.split(".")[:2])) for p in visits.iterdir())


SCHEMA = "bbbs string, title string, sxx int, extra string"


def test_every_row_and_each_page_once(spark, service):
    fetch, visited = service
    rows = paged(spark, fetch, SCHEMA, [1, 2, 3, 4], size=5).collect()
    assert sorted(r["bbbs"] for r in rows) == sorted(f"{c}-{i}" for c, n in TOTAL.items() for i in range(n))
    assert all(r["bbbs"].startswith(f"{r['code']}-") and r["extra"] is None for r in rows) and any(r["sxx"] is None for r in rows)
    assert visited() == sorted([(1, p) for p in range(1, 6)] + [(2, 1), (3, 1), (3, 2), (4, 1)])


def test_limit_and_partitions(spark, service):
    fetch, visited = service
    found = paged(spark, fetch, SCHEMA, [1, 3, 4], size=5, limit=7)
    assert found.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect() == [(1, 7), (3, 7), (4, 1)]
    assert visited() == [(1, 1), (1, 2), (3, 1), (3, 2), (4, 1)]


def test_filters_on_code_reach_the_source(spark, service):
    fetch, visited = service
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = paged(spark, fetch, SCHEMA, [1, 3, 4], size=5).filter("code = 3 and sxx = 1").collect()
        assert {r["bbbs"] for r in rows} == {"3-1", "3-9"} and {c for c, _ in visited()} == {3}
        assert paged(spark, fetch, SCHEMA, [1, 3, 4], size=5).filter("code in (4, 9)").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_nothing_listed(spark, service):
    fetch, visited = service
    assert paged(spark, fetch, SCHEMA, [2], size=5).count() == 0 and visited() == [(2, 1)]
    assert paged(spark, fetch, SCHEMA, []).count() == 0
