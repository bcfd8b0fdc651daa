"""Table versions: copy-on-write frames, written to the shared folder so that lineage stays short."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def version_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="versions-")
    return f"{base.rstrip('/')}/version-{uuid.uuid4().hex}"


def folders(df: DataFrame) -> set[str]:
    """The names of the folders that a frame's file tables lie in."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(i).getName() for i in range(roots.size())}
    return out


class Tables:
    """Committed tables and those staged by an open transaction."""

    def __init__(self):
        self.committed: dict[str, DataFrame] = {}
        self.staged: dict[str, DataFrame] | None = None
        self.written: list[str] = []

    def __getitem__(self, name: str) -> DataFrame:
        return (self.staged or {}).get(name, self.committed[name]) if self.staged is not None else self.committed[name]

    def __contains__(self, name: str) -> bool:
        return name in self.committed or name in (self.staged or {})

    def put(self, name: str, df: DataFrame) -> None:
        target = self.committed if self.staged is None else self.staged
        target[name] = df

    def materialized(self, df: DataFrame) -> DataFrame:
        """The rows as they are now, as a table of their own."""
        path = version_folder(df.sparkSession)
        self.written.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes the written versions that no table reads any more, committed or staged; how many."""
        used = set().union(*[folders(df) for df in [*self.committed.values(), *(self.staged or {}).values()]])
        old = [p for p in self.written if p.rsplit("/", 1)[1] not in used]
        for p in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.written = [p for p in self.written if p not in old]
        return len(old)

    def begin(self) -> None:
        self.staged = {}

    def commit(self) -> None:
        self.committed |= self.staged or {}
        self.staged = None

    def rollback(self) -> None:
        self.staged = None
