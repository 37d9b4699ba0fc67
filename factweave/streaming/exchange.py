"""Exchange of snapshots between stores over a shared folder. A version is a folder; a push writes its
values aside and takes the next number by renaming them there, which fails if another store has it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from factweave.operators.merge import VALUES, Snapshot, merge2, merge3

TRIES = 5
NO_TOMBS = "target_type string, target_value string, key string, ts long, email string"


@dataclass
class Exchange:
    """``versions/N`` holds version N whole. The rename without overwriting is the only step that stores may
    race for, so the folder must lie in a file system where it is atomic, as in HDFS. What a store that died
    had written aside is never read."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def head(self) -> int:
        """Number of the newest version, -1 if there is none."""
        at = self._at("versions")
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        files = fs.listStatus(at) if fs.exists(at) else []
        return max((int(x.getPath().getName()) for x in files if x.getPath().getName().isdigit()), default=-1)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{version}")

    def commit(self, values: DataFrame, parent: int) -> bool:
        """Whether the values became the version after ``parent``."""
        aside = f"aside/{uuid.uuid4().hex}"
        values.select(*VALUES).write.parquet(f"{self.path}/{aside}")
        fs = self.spark._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        to = self._at(f"versions/{parent + 1}")
        files = fs.FileContext.getFileContext(to.toUri(), conf)
        files.mkdir(to.getParent(), fs.permission.FsPermission.getDirDefault(), True)
        try:
            files.rename(self._at(aside), to, how)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True


def merged(base: DataFrame | None, local: DataFrame, remote: DataFrame) -> DataFrame:
    if base is not None:
        return merge3(base, local, remote)
    none = local.sparkSession.createDataFrame([], NO_TOMBS)
    return merge2(Snapshot(local, none), Snapshot(remote, none)).values


def pull(shared: Exchange, local: DataFrame, base: int | None = None) -> tuple[DataFrame, int]:
    """The local values merged with the newest version, and that version's number."""
    head = shared.head()
    if head < 0 or head == base:
        return local, head
    return merged(shared.read(base) if base is not None and base >= 0 else None, local, shared.read(head)), head


def push(shared: Exchange, local: DataFrame, base: int | None = None, tries: int = TRIES) -> DataFrame:
    """Merges with the newest version and commits; if the head moved meanwhile, again, up to ``tries``
    times. Returns the committed values."""
    for _ in range(tries):
        values, head = pull(shared, local, base)
        if shared.commit(values, head):
            return shared.read(head + 1)
    raise RuntimeError(f"the head moved {tries} times")


def sync(shared: Exchange, local: DataFrame, base: int | None = None) -> DataFrame:
    """Pull, then push what came out."""
    values, head = pull(shared, local, base)
    return push(shared, values, head if head >= 0 else None)
