"""The stored log: Parquet by day beside two rollups, committed together by one manifest.

A batch writes its rows and its counters (seconds and minutes) under its own id, and becomes visible when a manifest
that names it is published. Readers resolve one manifest and so see rows, counters and watermark of one moment; a batch
id that is committed already is not taken twice. Counters are deltas that are summed when read.

A manifest file holds what its version changes, and every WHOLE versions the whole state, so that a commit writes little
however long the store lives. Of numbered batches (name-number, in rising order) only the highest is kept. Counters and
rows of many batches are compacted as batches are appended. A version is claimed by a link or a rename that fails if the
name is taken (atomic on local file systems and HDFS; on other stores there must be one committer at a time).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions.buckets import at, day_of
from cinderlog.model import LOGS, ROLLUP
from cinderlog.operators import rollup

FORMAT = 2
TABLES = ("logs", "rollup_1s", "rollup_1m")
#: Versions between whole manifests, and batches after which counters and rows are compacted.
WHOLE, COMPACT_COUNTERS, COMPACT_LOGS = 32, 64, 256
_NUMBERED = re.compile(r"(.+)-(\d+)")


class Conflict(RuntimeError):
    """Someone else has published this version."""


@dataclass(frozen=True)
class Manifest:
    """version counts up; folders are those of the live parts of each table; seconds are complete from second_from on."""

    version: int = 0
    format: int = FORMAT
    folders: dict[str, list[str]] = field(default_factory=lambda: {t: [] for t in TABLES})
    batches: list[str] = field(default_factory=list)
    #: The highest number of each name of numbered batches.
    marks: dict[str, int] = field(default_factory=dict)
    next_id: int = 1
    second_from: int = -(2**62)
    rows_from: int = -(2**62)

    def knows(self, batch: str) -> bool:
        m = _NUMBERED.fullmatch(batch)
        return int(m[2]) <= self.marks.get(m[1], -1) if m else batch in self.batches

    def with_batch(self, batch: str) -> Manifest:
        m = _NUMBERED.fullmatch(batch)
        return replace(self, marks=self.marks | {m[1]: int(m[2])}) if m else replace(self, batches=[*self.batches, batch])

    def changes(self, before: Manifest) -> dict:
        """What differs from the version before."""
        folders = {t: {"gone": [f for f in before.folders[t] if f not in set(self.folders[t])], "new": [f for f in self.folders[t] if f not in set(before.folders[t])]} for t in TABLES}
        plain = {k: v for k, v in asdict(self).items() if k not in ("folders", "batches", "marks") and v != getattr(before, k)}
        marks = {k: v for k, v in self.marks.items() if before.marks.get(k) != v}
        return plain | {"version": self.version, "format": FORMAT, "folders": folders, "batches": self.batches[len(before.batches) :], "marks": marks}

    def changed(self, by: dict) -> Manifest:
        folders = {t: [f for f in self.folders[t] if f not in set(by["folders"][t]["gone"])] + by["folders"][t]["new"] for t in TABLES}
        return replace(self, **(by | {"folders": folders, "batches": [*self.batches, *by["batches"]], "marks": self.marks | by["marks"]}))


def _migrated(found: dict) -> Manifest:
    """A whole manifest of the first format, in which all batches are listed and every version is whole."""
    out = Manifest(**(found | {"format": FORMAT, "batches": []}))
    for batch in found["batches"]:
        out = out.with_batch(batch)
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _file(self, version: int) -> dict:
        io = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            found = json.loads(io.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found["format"] not in (1, FORMAT):
            raise ValueError(f"manifest format {found['format']} is not {FORMAT}")
        return found

    def manifest(self, version: int | None = None) -> Manifest:
        """The current manifest, or that of a version: the last whole one before it and the changes since."""
        at = version or max(self._versions(), default=0)
        changes: list[dict] = []
        while at:
            found = self._file(at)
            if found["format"] == 1 or "whole" in found:
                start = _migrated(found) if found["format"] == 1 else Manifest(**found["whole"])
                break
            changes.append(found)
            at -= 1
        else:
            start = Manifest()
        for by in reversed(changes):
            start = start.changed(by)
        return start

    def write_first_format(self, manifest: Manifest) -> None:
        """Writes a manifest's file anew as the first format had it, for stores that older readers share."""
        batches = [*manifest.batches, *(f"{name}-{k}" for name, top in manifest.marks.items() for k in range(top + 1))]
        old = {k: v for k, v in asdict(manifest).items() if k != "marks"} | {"format": 1, "batches": batches}
        stream = self._fs.create(self._path(f"{self.root}/manifests/v{manifest.version:012d}.json"), True)
        stream.write(bytearray(json.dumps(old).encode()))
        stream.close()

    def publish(self, manifest: Manifest) -> Manifest:
        """Makes the manifest the current one, as the next version; fails if that version is taken."""
        if manifest.version < max(self._versions(), default=0):
            raise Conflict(f"version {manifest.version} isn't the last")
        before = self.manifest(manifest.version) if manifest.version else Manifest()
        manifest = replace(manifest, version=manifest.version + 1)
        whole = manifest.version % WHOLE == 0
        text = json.dumps({"format": FORMAT, "whole": asdict(manifest)} if whole else manifest.changes(before))
        to = self._path(f"{self.root}/manifests/v{manifest.version:012d}.json")
        draft = self._path(f"{self.root}/manifests/.draft-{manifest.version}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._claim(draft, to)
        finally:
            self._fs.delete(draft, False)
        return manifest

    def _claim(self, draft, to) -> None:
        """Gives the draft its name unless that is taken."""
        sc = self.spark.sparkContext
        uri = self._fs.makeQualified(to).toUri()
        try:
            if uri.getScheme() == "file":
                os.link(self._fs.makeQualified(draft).toUri().getPath(), uri.getPath())
                return
            hadoop = sc._jvm.org.apache.hadoop.fs
            options = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(uri, sc._jsc.hadoopConfiguration()).rename(draft, to, options)
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and not self._fs.exists(to):
                raise
            raise Conflict(f"{to.getName()} exists") from None

    # reading

    def _read(self, name: str, manifest: Manifest) -> DataFrame:
        schema = T.StructType([*(LOGS if name == "logs" else ROLLUP).fields])
        if name == "logs":
            schema = schema.add("day", T.DateType())
        base, folders = f"{self.root}/{name}", manifest.folders[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        # one scan over all live folders: batch= and day= are partition columns of the table's root
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders)).select(*schema.names)

    def logs(self, manifest: Manifest | None = None) -> DataFrame:
        """Live rows, with the partition column day."""
        manifest = manifest or self.manifest()
        rows = self._read("logs", manifest)
        if manifest.rows_from > -(2**62):
            rows = rows.where((F.col("timestamp") >= at(manifest.rows_from)) & (F.col("day") >= day_of(at(manifest.rows_from))))
        return rows

    def counters(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """Delta rows of rollup_1s or rollup_1m; several of a bucket count together."""
        manifest = manifest or self.manifest()
        rows = self._read(name, manifest)
        start = max(manifest.rows_from, manifest.second_from if name == "rollup_1s" else manifest.rows_from)
        return rows.where(F.col("bucket") >= at(start)) if start > -(2**62) else rows

    # writing

    def _write(self, name: str, table: DataFrame, folder: str) -> str:
        to = f"{self.root}/{name}/batch={folder}"
        if name == "logs":
            # rows of a day together, a large day in several files and small ones in a task, sorted for file statistics
            days = table.withColumn("day", day_of(F.col("timestamp"))).hint("rebalance", F.col("day"))
            days.sortWithinPartitions("day", "service", "timestamp", "id").write.mode("overwrite").partitionBy("day").parquet(to)
        else:
            table.write.mode("overwrite").parquet(to)
        return f"batch={folder}"

    def append(self, batch: str, entries: DataFrame, order: tuple[str, ...] = ("request", "index")) -> Manifest:
        """Stores valid entries (timestamp, level, service, message, attributes) with their counters, once for a batch id.

        order names whole-number columns of the arrival order, the last one below the stride of ids; ids rise with it.
        """
        manifest = self.manifest()
        if manifest.knows(batch):
            return manifest
        first, last = order
        size = entries.agg(F.max(first).alias("f"), F.max(last).alias("l")).first()
        if size["f"] is None:
            return self.publish(manifest.with_batch(batch))
        stride = size["l"] + 1
        number = (F.lit(manifest.next_id) + F.col(first) * F.lit(stride) + F.col(last)).cast("long")
        rows = entries.withColumn("id", number).select(*LOGS.names)
        folder = f"{batch}-{manifest.version + 1}"
        self._write("logs", rows, folder)
        stored = self.spark.read.schema(LOGS).parquet(f"{self.root}/logs/batch={folder}")
        seconds = rollup.by_second(stored)
        self._write("rollup_1s", seconds, folder)
        self._write("rollup_1m", rollup.fold(self.spark.read.schema(ROLLUP).parquet(f"{self.root}/rollup_1s/batch={folder}")), folder)
        folders = {t: [*manifest.folders[t], f"batch={folder}"] for t in TABLES}
        done = self.publish(replace(manifest, folders=folders, next_id=manifest.next_id + (size["f"] + 1) * stride).with_batch(batch))
        if len(done.folders["rollup_1m"]) >= COMPACT_COUNTERS:
            done = self.compact()
        return self.compact_logs() if len(done.folders["logs"]) >= COMPACT_LOGS else done

    def load(self, batch: str, logs: DataFrame) -> Manifest:
        """Bulk load of rows that have their ids, past the counters; rebuild() must follow."""
        manifest = self.manifest()
        folder = self._write("logs", logs.select(*LOGS.names), f"{batch}-{manifest.version + 1}")
        top = logs.agg(F.max("id")).first()[0] or 0
        folders = manifest.folders | {"logs": [*manifest.folders["logs"], folder]}
        return self.publish(replace(manifest, folders=folders, next_id=max(manifest.next_id, top + 1)).with_batch(batch))

    # maintenance

    def _replace(self, manifest: Manifest, seconds: DataFrame, minutes: DataFrame, tag: str) -> Manifest:
        folder = f"{tag}-{manifest.version + 1}"
        new = {"rollup_1s": [self._write("rollup_1s", seconds, folder)], "rollup_1m": [self._write("rollup_1m", minutes, folder)]}
        return self.publish(replace(manifest, folders=manifest.folders | new))

    def rebuild(self) -> Manifest:
        """Counts both grains anew from all rows."""
        manifest = self.manifest()
        seconds = rollup.by_second(self.logs(manifest))
        return self._replace(manifest, seconds, rollup.fold(seconds), "rebuild")

    def reconcile(self, start: int, end: int) -> Manifest:
        """Counts the whole minutes of [start, end) anew, in both grains."""
        manifest = self.manifest()
        logs = self.logs(manifest)
        seconds = rollup.reconcile(rollup.merge(self.counters("rollup_1s", manifest)), logs, start, end, "second")
        minutes = rollup.reconcile(rollup.merge(self.counters("rollup_1m", manifest)), logs, start, end)
        return self._replace(manifest, seconds, minutes, "reconcile")

    def repair(self) -> DataFrame:
        """The buckets of either grain that differ from the rows; if there are any, both grains are rebuilt."""
        manifest = self.manifest()
        logs = self.logs(manifest)
        kept = logs.where(F.col("timestamp") >= at(manifest.second_from)) if manifest.second_from > -(2**62) else logs
        seconds = rollup.bucket_drift(self.counters("rollup_1s", manifest), kept, "second").withColumn("grain", F.lit("second"))
        minutes = rollup.bucket_drift(self.counters("rollup_1m", manifest), logs).withColumn("grain", F.lit("minute"))
        found = seconds.unionByName(minutes)
        if not found.isEmpty():
            self.rebuild()
        return found

    def compact(self) -> Manifest:
        """One part of each rollup in place of many deltas."""
        manifest = self.manifest()
        return self._replace(manifest, rollup.merge(self.counters("rollup_1s", manifest)), rollup.merge(self.counters("rollup_1m", manifest)), "compact")

    def compact_logs(self, folders: int = 64) -> Manifest:
        """One part in place of the oldest that aren't compacted yet; batch ids stay known, and readers of older manifests keep theirs."""
        manifest = self.manifest()
        old = [f for f in manifest.folders["logs"] if not f.startswith("batch=compact-")][:folders]
        rest = [f for f in manifest.folders["logs"] if f not in set(old)]
        if len(old) < 2:
            return manifest
        rows = self.logs(replace(manifest, folders=manifest.folders | {"logs": old})).select(*LOGS.names)
        folder = self._write("logs", rows, f"compact-{manifest.version + 1}")
        return self.publish(replace(manifest, folders=manifest.folders | {"logs": [*rest, folder]}))

    def vacuum(self, versions: int = 2) -> list[str]:
        """Deletes the folders that none of the last so many manifests names, and older manifests; returns those folders."""
        kept = self._versions()[-versions:]
        live = {f"{t}/{f}" for v in kept for t, names in self.manifest(v).folders.items() for f in names}
        gone = []
        for table in TABLES:
            folder = self._path(f"{self.root}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = f"{table}/{s.getPath().getName()}"
                if name not in live:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        # changes are read from the last whole manifest on
        first = next((v for v in range(min(kept, default=0), 0, -1) if self._fs.exists(self._path(f"{self.root}/manifests/v{v:012d}.json")) and ("whole" in (f := self._file(v)) or f["format"] == 1)), 0)
        for v in self._versions():
            if v < first:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}.json"), False)
        return sorted(gone)

    def retain(self, today: int, days: int) -> tuple[Manifest, list[str]]:
        """Rows and counters older than so many days leave together; returns the days whose folders were deleted.

        Readers of the new manifest see neither; a day's files go after it is published.
        """
        if days < 1:
            raise ValueError("retention must be at least one day")
        manifest = self.manifest()
        cut = today - today % 86_400_000_000 - days * 86_400_000_000
        manifest = self.publish(replace(manifest, rows_from=max(manifest.rows_from, cut)))
        day = self.spark.range(1).select(day_of(at(manifest.rows_from)).cast("string")).first()[0]
        gone = set()
        for folder in manifest.folders["logs"]:
            at_folder = self._path(f"{self.root}/logs/{folder}")
            for s in self._fs.listStatus(at_folder) if self._fs.exists(at_folder) else []:
                name = s.getPath().getName()
                if name.startswith("day=") and name[4:] < day:
                    self._fs.delete(s.getPath(), True)
                    gone.add(name[4:])
        return manifest, sorted(gone)

    def prune_seconds(self, now: int, minutes: int) -> Manifest:
        """Seconds older than the window leave; the watermark never goes back."""
        manifest = self.manifest()
        return self.publish(replace(manifest, second_from=rollup.second_cutoff(now, minutes, manifest.second_from)))
