"""Versions of a snapshot in a folder: files by bucket, written once and shared between versions.

A bucket holds the files of some targets, by a hash of the target. Each version has a manifest: for every
bucket where its files lie and a digest of them. A version that follows another writes the buckets of the
targets that changed and names the others where they are, so what didn't change is neither rendered, read
nor written. A bucket that comes out as it was is named where it was, too; if all do, no new version
comes to be.

With its files each bucket keeps a digest of every leaf, a share of the files by a hash of their paths. Two
versions are compared from the top: buckets whose digests or places agree are left alone; of the others
only the leaf digests are read, and then only paths and content hashes of leaves that differ. Digests are counts and sums
of hashes, so neither the order of files nor their number in a task matters.

``files`` have path, content and the target's columns; within a version paths differ. Numbers of buckets
and leaves belong to a store and stay; choose buckets by the size that is fine to rewrite for one change. A
bucket of a target with very many files is split over several tasks. A version exists once its manifest is
written; one that failed before leaves files that no manifest names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.shared import exists, remove

TARGET = ("target_type", "target_value")
DIGEST = ("n", "g", "h")
FILE_COLUMNS = "path string, content string, {of}, leaf int, g long, h long"
LEAF_COLUMNS = "leaf int, n long, g decimal(38,0), h decimal(38,0)"
MANIFEST = "bucket int, at string, n long, g decimal(38,0), h decimal(38,0)"


def _summed() -> list[Column]:
    """Hashes count as whole numbers, so that no sum overflows."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")]


@dataclass
class Store:
    """``of`` names the columns that tell targets apart; each bucket has ``leaves`` leaves."""

    spark: SparkSession
    path: str
    buckets: int = 32
    leaves: int = 1 << 9
    of: tuple[str, ...] = TARGET
    _seen: dict[str, list] = field(default_factory=dict, repr=False)

    def exists(self, version: str) -> bool:
        return exists(self.spark, f"{self.path}/manifests/{version}")

    def manifest(self, version: str) -> dict[int, tuple]:
        """(place, digest) of each bucket; a row for each bucket, read once."""
        if version not in self._seen:
            self._seen[version] = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{version}").collect()
        return {r["bucket"]: (r["at"], tuple(r[c] for c in DIGEST)) for r in self._seen[version]}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.of), F.lit(self.buckets)).cast("int")

    def _hashed(self, files: DataFrame) -> DataFrame:
        leaf = (self._bucket() * self.leaves + F.pmod(F.xxhash64("path"), F.lit(self.leaves))).cast("int")
        return files.select("path", "content", *self.of, self._bucket().alias("bucket"), leaf.alias("leaf"), F.xxhash64("path", "content").alias("g"), F.xxhash64(F.lit(1), "content", "path").alias("h"))

    def _read(self, places: list[str], schema: str, kind: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{p}" for p in places]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _file_schema(self) -> str:
        return FILE_COLUMNS.format(of=", ".join(f"{c} string" for c in self.of))

    def files_at(self, places: list[str]) -> DataFrame:
        return self._read(places, self._file_schema(), "files")

    def read(self, version: str) -> DataFrame:
        """path, content and target of all files."""
        return self.files_at([at for at, _ in self.manifest(version).values()]).select("path", "content", *self.of)

    def _put(self, files: DataFrame, version: str) -> dict[int, tuple]:
        """Writes files and leaf digests, and returns what a manifest says of them."""
        self._hashed(files).hint("rebalance", "bucket").sortWithinPartitions("bucket", "leaf").write.partitionBy("bucket").parquet(f"{self.path}/files/{version}")
        written = self.spark.read.schema(self._file_schema() + ", bucket int").parquet(f"{self.path}/files/{version}")
        leaves = written.groupBy("bucket", "leaf").agg(*_summed())
        leaves.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/leaves/{version}")
        sums = self.spark.read.schema(LEAF_COLUMNS + ", bucket int").parquet(f"{self.path}/leaves/{version}").groupBy("bucket").agg(*(F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("g", "decimal(38,0)"), ("h", "decimal(38,0)"))))
        return {r["bucket"]: (f"{version}/bucket={r['bucket']}", tuple(r[c] for c in DIGEST)) for r in sums.collect()}

    def _commit(self, version: str, manifest: dict[int, tuple]) -> None:
        rows = [(b, at, *digest) for b, (at, digest) in sorted(manifest.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{version}")

    def write(self, files: DataFrame, version: str) -> None:
        """A version from all its files."""
        self._commit(version, self._put(files, version))

    def follow(self, parent: str, version: str, dirty: DataFrame, files: DataFrame) -> list[int]:
        """A version in which the ``dirty`` targets have ``files`` (of theirs only) and all others what they
        had in ``parent``. Returns the buckets that changed; if there are none, there is no new version."""
        targets = dirty.select(*self.of).distinct()
        touched = {r["bucket"] for r in targets.select(self._bucket().alias("bucket")).distinct().collect()}
        before = self.manifest(parent)
        old = self.files_at([before[b][0] for b in sorted(touched & set(before))])
        kept = old.join(targets, list(self.of), "left_anti")
        columns = ["path", "content", *self.of]
        after = self._put(kept.select(*columns).unionByName(files.join(targets, list(self.of), "left_semi").select(*columns)), version)
        changed = sorted(b for b in touched if after.get(b, (None, None))[1] != before.get(b, (None, None))[1])
        same = [b for b in after if b not in changed]
        remove(self.spark, *(f"{self.path}/{kind}/{after[b][0]}" for kind in ("files", "leaves") for b in same))
        if changed:
            self._commit(version, {b: x for b, x in before.items() if b not in touched or b in same} | {b: after[b] for b in changed if b in after})
        else:
            remove(self.spark, *(f"{self.path}/{kind}/{version}" for kind in ("files", "leaves")))
        return changed

    def differing(self, a: str, b: str) -> tuple[list[str], list[str]]:
        """Places of the buckets whose files may differ, in a and in b."""
        x, y = self.manifest(a), self.manifest(b)
        apart = [k for k in sorted({*x, *y}) if x.get(k, (None, None))[1] != y.get(k, (None, None))[1]]
        return [x[k][0] for k in apart if k in x], [y[k][0] for k in apart if k in y]

    def unchanged(self, a: str, b: str) -> bool:
        """Whether two versions have equal files; only manifests are read."""
        return self.differing(a, b) == ([], [])

    def diff(self, a: str, b: str, contents: bool = False) -> DataFrame:
        """path and A, M or D from version a to b; with ``contents`` also what b has there."""
        places = self.differing(a, b)
        schema = "path string, status string" + ", content string" * contents
        if places == ([], []):
            return self.spark.createDataFrame([], schema)
        sums = lambda at: self._read(at, LEAF_COLUMNS, "leaves").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
        x, y = (sums(at).select("leaf", F.struct(*DIGEST).alias(side)) for at, side in zip(places, "xy", strict=True))
        apart = x.join(y, "leaf", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("leaf")
        apart = F.broadcast(apart)  # at most all leaves of a store
        old = self.files_at(places[0]).join(apart, "leaf", "left_semi").select("path", F.struct("g", "h").alias("x"))
        new = self.files_at(places[1]).join(apart, "leaf", "left_semi").select("path", F.struct("g", "h").alias("y"), *["content"] * contents)
        status = F.when(F.col("x").isNull(), "A").when(F.col("y").isNull(), "D").when(F.col("x") != F.col("y"), "M")
        return old.join(new, "path", "full").select("path", status.alias("status"), *["content"] * contents).where("status is not null")
