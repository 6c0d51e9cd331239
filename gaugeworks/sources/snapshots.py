"""Snapshots of the store: which files are live, and what bounds they have.

A manifest has a row per file and station group in it with the station and time bounds,
as recorded when the file was written.  A query takes its files from there: it lists no folder, and
opens only files that can hold rows of the range it asks for.

A snapshot names the manifest parts that make it up, in a small numbered file.  It
is committed by writing that file under the next number, which only one writer
can do.  Data files are never changed by it, so that a reader sees the snapshot it
began with, old or new, and a writer that dies before its commit changes nothing.
The loser of two commits looks at the winner's snapshot: an ingest adds its files
to that one; a compaction gives up if files it rewrote are no longer live, and
otherwise goes in front of what was added meanwhile.

Compaction rewrites closed years, which many small ingests left in many small
files, with the rows of each year and station group together.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.functions.dates import ts_of
from gaugeworks.schemas import CATALOG, MANIFEST, OBS_COLUMNS
from gaugeworks.sources import store

COMMITS_TRIED = 50


@dataclass(frozen=True)
class Part:
    """Manifest rows of some ingests; those of ``without`` are no longer live."""

    path: str
    ingests: tuple[str, ...]
    without: tuple[str, ...] = ()

    def dropping(self, ingests: set[str]) -> Part | None:
        """The part without these ingests; nothing where none are left."""
        gone = set(self.without) | (ingests & set(self.ingests))
        return replace(self, without=tuple(sorted(gone))) if gone < set(self.ingests) else None


@dataclass(frozen=True)
class Snapshot:
    number: int
    parts: tuple[Part, ...]


def _commits(root: str, kind: str) -> str:
    return f"{root}/snapshots/data_type={kind}"


def _commit_file(root: str, kind: str, number: int) -> str:
    return f"{_commits(root, kind)}/{number:012d}.json"


def snapshot(spark: SparkSession, root: str, kind: str, number: int) -> Snapshot:
    """A snapshot that has not been cleaned up yet."""
    told = json.loads(store.get_bytes(spark, _commit_file(root, kind, number)))
    parts = (Part(p["path"], tuple(p["ingests"]), tuple(p["without"])) for p in told["parts"])
    return Snapshot(number, tuple(parts))


def latest(spark: SparkSession, root: str, kind: str) -> Snapshot | None:
    """The last snapshot committed; nothing before the first."""
    names = store.listed(spark, f"{_commits(root, kind)}/*.json")
    if not names:
        return None
    return snapshot(spark, root, kind, max(int(name.rsplit("/", 1)[1].split(".")[0]) for name in names))


def commit(
    spark: SparkSession, root: str, kind: str,
    change: Callable[[tuple[Part, ...]], tuple[Part, ...] | None],
) -> Snapshot | None:
    """Commit what ``change`` makes of the last snapshot's parts, asked again after
    every commit that was lost; nothing is committed where it gives up."""
    for _ in range(COMMITS_TRIED):
        base = latest(spark, root, kind) or Snapshot(0, ())
        parts = change(base.parts)
        if parts is None:
            return None
        made = Snapshot(base.number + 1, parts)
        told = json.dumps({"parts": [asdict(p) for p in parts]}).encode()
        if store.put_once(spark, _commit_file(root, kind, made.number), told):
            return made
    raise RuntimeError(f"{COMMITS_TRIED} other commits came first")


def _manifest_rows(recorded: DataFrame) -> DataFrame:
    """Manifest rows of recorded chunks: a file has one year, and one row for each of its
    station groups."""
    group = store.station_group(F.col("station_id")).alias("station_group")
    return recorded.groupBy("file", "file_size", "ingest_id", "year", group).agg(
        F.min("station_id").alias("min_station"), F.max("station_id").alias("max_station"),
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
        F.sum("row_count").alias("row_count"), F.sum("checksum").cast("decimal(38,0)").alias("checksum"),
    ).select(*_names(MANIFEST))


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _write_part(rows: DataFrame, root: str, kind: str, ingests: tuple[str, ...]) -> Part:
    path = f"manifest/data_type={kind}/part-{uuid.uuid4().hex}"
    rows.hint("rebalance").write.parquet(f"{root}/{path}")
    return Part(path, ingests)


def publish(spark: SparkSession, root: str, kind: str, *ingests: str) -> Snapshot:
    """Make the recorded files of these ingests live, in place of what they had before."""
    recorded = store.read_files_of(spark, root, kind, ingests)
    part = _write_part(_manifest_rows(recorded), root, kind, tuple(sorted(ingests)))

    def change(parts):
        kept = (p.dropping(set(ingests)) for p in parts)
        return (*(p for p in kept if p is not None), part)

    return commit(spark, root, kind, change)


def files(spark: SparkSession, root: str, kind: str, at: Snapshot | None = None) -> DataFrame:
    """Live files of a snapshot, the last one unless told, with a row per station group in them."""
    at = at or latest(spark, root, kind) or Snapshot(0, ())
    by_lack: dict[tuple[str, ...], list[str]] = {}
    for part in at.parts:
        by_lack.setdefault(part.without, []).append(f"{root}/{part.path}")
    rows = spark.createDataFrame([], MANIFEST)
    for without, paths in by_lack.items():
        more = spark.read.schema(MANIFEST).parquet(*paths)
        rows = rows.unionByName(more.where(~F.col("ingest_id").isin(list(without))) if without else more)
    return rows


def read_obs(
    spark: SparkSession, root: str, kind: str, station: int | None = None,
    start: str | None = None, end: str | None = None, at: Snapshot | None = None,
) -> DataFrame:
    """Rows of the live files that can hold a station's rows from ``start`` up to but
    not including ``end``; bounds that are not given hold for all.

    The paths of the chosen files are all that reaches the driver, as for any scan.
    """
    chosen = files(spark, root, kind, at)
    if station is not None:
        chosen = chosen.where(F.lit(station).between(F.col("min_station"), F.col("max_station")))
    if start is not None:
        chosen = chosen.where((F.col("max_ts") >= ts_of(start, kind)) & (F.col("year") >= int(start[:4])))
    if end is not None:
        chosen = chosen.where((F.col("min_ts") < ts_of(end, kind)) & (F.col("year") <= int(end[:4])))
    paths = sorted(_paths(root, chosen))
    return store.read_paths(spark, root, kind, paths)


def _paths(root: str, chosen: DataFrame) -> list[str]:
    return [f"{root}/{r['file']}" for r in chosen.select("file").distinct().collect()]


def _live_folders(spark: SparkSession, root: str, kind: str, at: Snapshot) -> DataFrame:
    return files(spark, root, kind, at).select("ingest_id", "year").distinct()


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The recorded chunks whose files are live, of both kinds of rows."""
    recorded = store.read_catalog(spark, root)
    rows = spark.createDataFrame([], CATALOG)
    for kind in OBS_COLUMNS:
        own, at = recorded.where(F.col("data_type") == kind), latest(spark, root, kind)
        if at is not None:
            own = own.join(_live_folders(spark, root, kind, at), ["ingest_id", "year"], "left_semi")
        rows = rows.unionByName(own)
    return rows


def compact(spark: SparkSession, root: str, kind: str, before_year: int) -> Snapshot | None:
    """Rewrite the closed years, those before ``before_year``, that several ingests
    share.  Gives nothing where there are none, or where another writer replaced
    files of theirs meanwhile; then what was written is deleted."""
    base = latest(spark, root, kind)
    if base is None:
        return None
    live = files(spark, root, kind, base)
    shared = live.where(F.col("year") < before_year).groupBy("year", "station_group").agg(
        F.count_distinct("ingest_id").alias("n")).where("n > 1")
    years = sorted(r["year"] for r in shared.select("year").distinct().collect())
    if not years:
        return None
    closed = live.where(F.col("year").isin(years))
    made = f"compact-{uuid.uuid4().hex}"
    rows = store.read_paths(spark, root, kind, _paths(root, closed))
    store.write_obs(rows, root, kind, made)
    store.write_catalog(spark, root, kind, made)
    written = _manifest_rows(store.read_files_of(spark, root, kind, (made,)))
    _same_rows(closed, written)
    left = live.where(~F.col("year").isin(years)).unionByName(written)
    ingests = tuple(sorted(r["ingest_id"] for r in left.select("ingest_id").distinct().collect()))
    part = _write_part(left, root, kind, ingests)

    def change(parts):
        return (part, *parts[len(base.parts):]) if parts[:len(base.parts)] == base.parts else None

    done = commit(spark, root, kind, change)
    if done is None:
        store.delete(spark, f"{root}/{part.path}")
        for table in ("catalog/", "files/", ""):
            store.delete(spark, f"{root}/{table}data_type={kind}/ingest_id={made}")
    return done


def _same_rows(one: DataFrame, other: DataFrame) -> None:
    """Checksums add up whatever files the rows are in."""
    total = lambda rows: tuple(rows.agg(F.sum("row_count"), F.sum("checksum")).first())
    if total(one) != total(other):
        raise RuntimeError("the rewritten rows are not those that were read")


def clean(spark: SparkSession, root: str, kind: str, older_than_seconds: float) -> list[str]:
    """Delete data, manifest parts and commits that the last snapshot does not use and
    that are older than any reader or unfinished writer.  Gives what was deleted."""
    at = latest(spark, root, kind)
    if at is None:
        return []
    live = {(r["ingest_id"], r["year"]) for r in _live_folders(spark, root, kind, at).collect()}
    named = {p.path.rsplit("/", 1)[1] for p in at.parts}
    last = f"{at.number:012d}.json"

    def unused(path):
        if "/year=" in path:
            ingest, year = path.split("/ingest_id=")[1].split("/year=")
            return (ingest, int(year)) not in live
        name = path.rsplit("/", 1)[1]
        return name not in named and name != last

    globs = (f"{root}/data_type={kind}/ingest_id=*/year=*", f"{root}/manifest/data_type={kind}/part-*",
             f"{_commits(root, kind)}/*")
    limit = time.time() - older_than_seconds
    deleted = []
    for glob in globs:
        for path in store.listed(spark, glob, before=limit):
            if unused(path):
                store.delete(spark, path)
                deleted.append(path)
    return deleted
