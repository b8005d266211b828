"""Stages on disk: each is a Parquet folder that counts once Spark's commit marker is there."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class StageStore:
    """Get or compute named tables under a root on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True, halt_after: str | None = None) -> None:
        self.spark, self.root, self.enabled, self.halt_after = spark, root.rstrip("/"), enabled, halt_after
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _at(self, name: str, *more: str):
        path = self._path("/".join([self.root, name, *more]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, name: str) -> bool:
        fs, path = self._at(name, "_SUCCESS")
        return fs.exists(path)

    def stage(self, name: str, compute: Callable[[], DataFrame] | DataFrame) -> DataFrame:
        """The stored table, computed and written first unless it is done. Where the store is disabled, the plan itself."""
        build = compute if callable(compute) else lambda: compute
        if not self.enabled:
            return build()
        if not self.done(name):
            with scope():
                build().write.mode("overwrite").parquet(self.path(name))
        if name == self.halt_after:
            raise StopIteration(f"halted after stage {name}")
        return self.spark.read.parquet(self.path(name))

    def stage_by_files(self, name: str, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
        """A stage that resumes within itself. The files behind `rows`, a Parquet table, make `parts` parts, which are computed and committed
        one by one; `compute` must do each row's work alone (or each file's), as it sees one part at a time. A manifest, written first, fixes
        which files make which part; a part whose files or their sizes have changed since is computed again. The stage's own marker comes last."""
        if not self.enabled:
            return compute(rows)
        if not self.done(name):
            schema, manifest = rows.schema, self._manifest(name, rows.inputFiles(), parts)
            for k, files in enumerate(manifest):
                if files and not self.done(f"{name}/resume_part={k}"):
                    with scope():
                        compute(self.spark.read.schema(schema).parquet(*files)).write.mode("overwrite").parquet(self.path(f"{name}/resume_part={k}"))
            fs, marker = self._at(name, "_SUCCESS")
            fs.create(marker).close()
        if name == self.halt_after:
            raise StopIteration(f"halted after stage {name}")
        return self.spark.read.parquet(self.path(name)).drop("resume_part")

    def _manifest(self, name: str, files: list[str], parts: int) -> list[list[str]]:
        """Files of each part, by size; parts that the stored manifest says otherwise of are deleted."""
        sizes = {}
        for f in files:
            at = self._path(f)
            sizes[f] = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
        fs, path = self._at(name, "_manifest")
        old = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path), "UTF-8")) if fs.exists(path) else None
        if old is not None and len(old) == parts and sorted(f for p in old for f, _ in p) == sorted(sizes):
            new = [[[f, sizes[f]] for f, _ in p] for p in old]
        else:
            new, load = [[] for _ in range(parts)], [0] * parts
            for f in sorted(sizes, key=lambda f: (-sizes[f], f)):
                k = load.index(min(load))
                new[k].append([f, sizes[f]])
                load[k] += sizes[f]
        for k in range(max(parts, len(old or ()))):
            if (new[k] if k < parts else None) != (old[k] if old and k < len(old) else None):
                self.clear(f"{name}/resume_part={k}")
        if new != old:
            out = fs.create(path, True)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
        return [[f for f, _ in p] for p in new]

    def clear(self, name: str | None = None) -> None:
        fs, path = self._at(name or "")
        fs.delete(path, True)

    def names(self, suffix: str = "") -> list[str]:
        """Of done stages, in order."""
        fs, root = self._at("")
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in found if n.endswith(suffix) and self.done(n))

    def union(self, suffix: str) -> DataFrame:
        """All done stages with that suffix, by column name."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.stage(n, lambda: None) for n in self.names(suffix)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one, which
    the library remembers; the session's settings stay as they are."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(context, "_litgraph_shared", None):
        context._litgraph_shared = "file://" + tempfile.mkdtemp(prefix="litgraph-")
    return context._litgraph_shared


#: The tables of the innermost scope.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scope():
    """Tables that `scratch` makes inside are deleted at its end, when what is made of them has been written. Those taken off the list stay."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        drop(*made)


def scratch(df: DataFrame) -> DataFrame:
    """df, read back from a table in the shared folder, so that later reads see the same rows and partitions. `drop` deletes it, or the end of
    the `scope` that it is made in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of `scratch` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.path_)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_lines(df: DataFrame) -> list[str]:
    """The names under which tasks find (SparkFiles.get) the files of df's one column of strings, written as lines by tasks and in df's order.
    Spark asks for such files on every executor that starts later, so they stay as long as the session does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    df.write.option("compression", "none").text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.getLen() and s.getPath().getName().startswith("part-")]
    for file in found:
        spark.sparkContext.addFile(file.toUri().toString())
    return [file.getName() for file in found]
