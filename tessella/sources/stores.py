"""Sources in any store that Spark reads: roots that are URIs (``hdfs://``, ``s3a://``, ``file://`` and so on).

They are listed through the store's own client, by the same globs, sizes, types and ignore files as folders on disk, and
their files are read by Spark's tasks. Names that begin with a dot or an underscore are left out, as Spark's readers leave
them out; ignore files are honoured, but only from the root down. A file is shown by its whole URI.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import discover as D

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]+:/"


def remote(path: Column) -> Column:
    """Whether a path is a URI."""
    return path.rlike(_SCHEME)


def is_uri(path: str) -> bool:
    return bool(re.match(_SCHEME, path))


class Store:
    """The store that holds a URI, and the URI as the store writes it."""

    def __init__(self, spark: SparkSession, uri: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.at = self.fs.makeQualified(at)
        self.uri = self.at.toString()

    def text(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode(errors="replace")
        finally:
            stream.close()


def root_names(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots as they are shown: URIs as their stores write them, paths as ``shown_path`` does."""
    return [Store(spark, p).uri if is_uri(p) else D.shown_path(p) for p in roots]


def discover(spark: SparkSession, roots: list[str], include: list[str] = (), exclude: list[str] = (), most_bytes: int = D.MOST_BYTES, use_ignore: bool = True) -> D.Found:
    """Files under folders, paths and URIs, each once; what is on disk comes first."""
    found = D.discover([r for r in roots if not is_uri(r)], include, exclude, most_bytes, use_ignore)
    seen: set[str] = set()
    for root in roots:
        if not is_uri(root):
            continue
        store = Store(spark, root)
        if not store.fs.exists(store.at):
            raise FileNotFoundError(f"path not found: {root}")
        todo = [(store.fs.getFileStatus(store.at), [], True)]
        while todo:
            status, layers, named = todo.pop()
            path = status.getPath().toString()
            if status.isDirectory():
                todo += _inside(store, status, layers, exclude, use_ignore)
            elif path not in seen:
                what = D.verdict(path, status.getLen(), named, include, exclude, most_bytes)
                if what == "take" and _hidden(status.getPath().getName()):
                    found.skipped.append(f"{path} (hidden name)")
                elif what == "large":
                    found.skipped.append(f"{path} (over {most_bytes >> 20} MB)")
                elif what == "take":
                    seen.add(path)
                    found.files.append((path, path, status.getLen(), status.getModificationTime() / 1000))
    return found


def _hidden(name: str) -> bool:
    return name[:1] in (".", "_") or name.endswith("._COPYING_")


def _inside(store: Store, folder, layers: list, exclude: list[str], use_ignore: bool) -> list[tuple]:
    """What a folder holds and is to be walked, last name first, each with the ignore rules that apply to it."""
    entries = {s.getPath().getName(): s for s in store.fs.listStatus(folder.getPath())}
    if use_ignore and ".gitignore" in entries:
        layers = [*layers, (folder.getPath().toString(), D.ignore_rules(store.text(entries[".gitignore"].getPath())))]
    out = []
    for name in sorted(entries, reverse=True):
        status, path = entries[name], entries[name].getPath().toString()
        below = status.isDirectory()
        if _hidden(name) or below and (name in D.SKIP_DIRS or D._fits(path, list(exclude))) or D.is_ignored(path, below, layers):
            continue
        out.append((status, layers, False))
    return out


def contents(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(path, content) of files in stores, read by Spark's own source, a few files a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", False)
    return files.load(uris).select("path", "content") if uris else spark.createDataFrame([], "path string, content binary")


def uris_of(listed: DataFrame) -> list[str]:
    """The URIs among listed files that a step is to read; the driver made the listing that they are from."""
    return [r["file"] for r in listed.filter(remote(F.col("file"))).select("file").collect()]
