"""Tables in versions: replacement by source with atomic commits, conflict detection and snapshots.

Rows lie in folders by a hash of their source, so their number does not grow with the sources. A commit writes the buckets it
changes to folders of its own, which never change again, and then one small manifest that names the folder of every bucket. A
manifest's name is its version, and the file system lets one writer only create it.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.storage import discard, scratch, staged

#: Rows of a file at most, about: a bucket that holds more is written by several tasks.
FILE_ROWS = 1_000_000
#: Sources of one replacement up to which they are broadcast to the rows they replace.
BROADCAST_SOURCES = 200_000


class Conflict(Exception):
    """Another writer has changed the same buckets since this one read them."""


def _jpath(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    where, fs = _jpath(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def _created(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file whole, or tell that it is there already.

    The content is written under another name and moved. Moving fails if the name is taken: on a local disk by a hard link,
    elsewhere by the rename of the file system, which must be atomic, as that of HDFS is.
    """
    where, fs = _jpath(spark, path)
    draft, _ = _jpath(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(content, "utf-8"))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), where.toUri().getPath())
        else:
            if fs.exists(where):
                return False
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, where, none)
    except FileExistsError:
        return False
    except (Py4JJavaError, CapturedException):
        if fs.exists(where):
            return False
        raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
    return True


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/versions/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, oldest first; none where there is no table."""
    names = [s.getPath().getName() for s in _listed(spark, f"{path}/versions")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version's manifest, of the newest where none is named: schema, source, n_buckets, buckets (number: folder), applied.

    Its size is bounded by the number of buckets, which is fixed when the table is made.
    """
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {'' if version is None else f'{version} '}of a table at {path}")
    at = known[-1] if version is None else version
    text = "\n".join(r["value"] for r in spark.read.text(_manifest_path(path, at)).collect())
    return {**json.loads(text), "version": at}


def _bucket(source: Column, n: int) -> Column:
    """A source's bucket; a null source has one too."""
    return F.pmod(F.xxhash64(source), F.lit(n)).cast("int")


def _opened(spark: SparkSession, path: str, held: dict, numbers: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(held["schema"])
    folders = [f"{path}/data/{held['buckets'][b]}" for b in numbers]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None, sources: list | None = None) -> DataFrame:
    """The rows of a version, the newest where none is named. With ``sources`` only theirs, and only their buckets are opened.

    The rows are those of that version whatever is committed later, until ``vacuum`` lets the version go.
    """
    held = manifest(spark, path, version)
    if sources is None:
        return _opened(spark, path, held, sorted(held["buckets"]))
    schema = T.StructType.fromJson(held["schema"])
    kind = T.StructType([T.StructField("s", schema[held["source"]].dataType)])
    asked = spark.createDataFrame([(s,) for s in sources], kind)
    numbers = {str(r["b"]) for r in asked.select(_bucket(F.col("s"), held["n_buckets"]).alias("b")).distinct().collect()}
    rows = _opened(spark, path, held, sorted(numbers & set(held["buckets"])))
    return rows.join(F.broadcast(asked.distinct()), F.col(held["source"]).eqNullSafe(F.col("s")), "left_semi")


def _write(rows: DataFrame, path: str, source: str, n: int, work: str) -> dict[str, str]:
    """Write ``rows`` to the folders of a new commit; the folder of each bucket that has rows."""
    spark, commit = rows.sparkSession, uuid.uuid4().hex
    marked = rows.withColumn("_bucket", _bucket(F.col(source), n))
    counts = staged(marked.groupBy("_bucket").agg(F.count("*").alias("_n")), f"{work}/counts")  # a row a bucket
    found = [r["_bucket"] for r in counts.select("_bucket").collect()]
    if not found:
        return {}
    # a source may hold a third of all rows: its bucket is dealt to as many tasks as its rows fill files
    hashable = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashable), F.ceil(F.col("_n") / FILE_ROWS)).cast("int")
    dealt = marked.join(F.broadcast(counts), "_bucket").withColumn("_part", salt)
    tasks = counts.agg(F.sum(F.ceil(F.col("_n") / FILE_ROWS))).first()[0]
    dealt.repartition(int(tasks), "_bucket", "_part").drop("_n", "_part").write.partitionBy("_bucket").parquet(f"{path}/data/{commit}")
    return {str(b): f"{commit}/_bucket={b}" for b in found}


def _commit(spark: SparkSession, path: str, base: dict | None, after: dict, changed: set[str]) -> int:
    """Make ``after`` the next version. Commits since ``base`` that changed other buckets are taken over; others conflict."""
    start = base["version"] if base else 0
    body = {k: v for k, v in after.items() if k != "version"}
    while not _created(spark, _manifest_path(path, start + 1), json.dumps(body)):
        start += 1
        now = manifest(spark, path, start)
        before = base["buckets"] if base else {}
        theirs = {b for b in set(before) | set(now["buckets"]) if before.get(b) != now["buckets"].get(b)}
        if base is None or theirs & changed or body["schema"] != now["schema"]:
            raise Conflict(f"version {start} of {path} changed the same buckets")
        own = {b: f for b, f in body["buckets"].items() if b in changed}
        kept = {b: f for b, f in now["buckets"].items() if b not in changed}
        body = {**now, "buckets": kept | own, "applied": now["applied"] | {k: v for k, v in body["applied"].items() if v > now["applied"].get(k, -1)}}
        body.pop("version")
    return start + 1


def replace(incoming: DataFrame, path: str, source: str = "source", buckets: int = 256, batch: tuple[str, int] | None = None, attempts: int = 5) -> int:
    """Commit ``incoming``: its sources' rows replace all rows of these sources, others stay. The version that has them.

    The first commit makes the table, with ``buckets`` buckets. Rows with a null source are a source of their own; repeated rows
    stay; a table without rows changes nothing but makes the table. Columns must be those of the table, in any order
    (ValueError otherwise). ``batch``, a name and a number, is applied once: a later call with a number not above the last one of that name
    changes nothing. A writer that dies leaves folders that no version names. Where another commit changed the same buckets
    meanwhile, the work is done again on top of it, up to ``attempts`` times, then Conflict is raised.
    """
    spark = incoming.sparkSession
    work = scratch(spark)
    try:
        incoming = staged(incoming, f"{work}/incoming")  # the same rows in every attempt
        for attempt in range(attempts):
            known = versions(spark, path)
            base = manifest(spark, path, known[-1]) if known else None
            if base and batch and base["applied"].get(batch[0], -1) >= batch[1]:
                return base["version"]
            try:
                return _replaced(incoming, path, source, buckets, batch, base, f"{work}/{attempt}")
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be at least 1")
    finally:
        discard(spark, work)


def _replaced(incoming: DataFrame, path: str, source: str, buckets: int, batch: tuple[str, int] | None, base: dict | None, work: str) -> int:
    spark = incoming.sparkSession
    applied = {batch[0]: batch[1]} if batch else {}
    if base is None:
        named = _write(incoming, path, source, buckets, work)
        after = {"schema": _nullable(incoming.schema), "source": source, "n_buckets": buckets, "buckets": named, "applied": applied}
        _prepared(spark, path)
        return _commit(spark, path, None, after, set(named))
    schema = T.StructType.fromJson(base["schema"])
    if {(f.name, f.dataType.simpleString()) for f in schema} != {(f.name, f.dataType.simpleString()) for f in incoming.schema} or source != base["source"]:
        raise ValueError(f"the table at {path} has columns {schema.simpleString()} and source {base['source']}")
    n = base["n_buckets"]
    own = staged(incoming.select(F.col(source).alias("_s")).distinct(), f"{work}/sources")
    touched = {str(r["b"]) for r in own.select(_bucket(F.col("_s"), n).alias("b")).distinct().collect()}
    gone = F.broadcast(own) if own.count() <= BROADCAST_SOURCES else own  # beyond that adaptive execution splits a frequent source
    stay = _opened(spark, path, base, sorted(touched & set(base["buckets"]))).join(gone, F.col(source).eqNullSafe(F.col("_s")), "left_anti")
    named = _write(stay.unionByName(incoming.select(*schema.names)), path, source, n, work)
    after = {**base, "buckets": {b: f for b, f in base["buckets"].items() if b not in touched} | named, "applied": base["applied"] | applied}
    return _commit(spark, path, base, after, touched)


def _nullable(schema: T.StructType) -> dict:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).jsonValue()


def _prepared(spark: SparkSession, path: str) -> None:
    where, fs = _jpath(spark, f"{path}/versions")
    fs.mkdirs(where)


def vacuum(spark: SparkSession, path: str, keep: int = 10, idle_hours: float = 24.0) -> list[int]:
    """Let all but the newest ``keep`` versions go, and delete folders that no other names; the versions that went.

    Folders younger than ``idle_hours`` stay, as a writer may not have committed them yet.
    """
    known = versions(spark, path)
    gone, stay = known[: max(0, len(known) - max(1, keep))], known[-max(1, keep) :]
    named = {f.split("/")[0] for v in stay for f in manifest(spark, path, v)["buckets"].values()}
    for v in gone:
        discard(spark, _manifest_path(path, v))
    limit = (time.time() - idle_hours * 3600) * 1000
    for status in _listed(spark, f"{path}/data"):
        if status.getPath().getName() not in named and status.getModificationTime() <= limit:
            discard(spark, status.getPath().toString())
    return gone
