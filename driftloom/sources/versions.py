"""Several tables written as one commit, in a folder that any of Spark's file systems holds.

A commit writes all tables under a name of its own, then puts one small file ``v<number>`` beside them, which tells that name.
The file is made only if it isn't there yet, in one step of the file system: of two writers of one number one wins and the
other takes the next. Readers follow the file of the highest number, so they see all tables of a commit or none of them; what
a broken run has left is never seen, and ``vacuum`` takes it away.

A file system makes a file only once if it can create without overwriting (HDFS, local disks), or put if absent. Stores
without either can't tell two writers apart; there commits must come from one writer.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def made_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file; False if it was there. The text is complete when others see the name.

    The text goes to a name of its own first. A rename that refuses to overwrite then gives it the name: HDFS and object
    stores do that for files; on local disks, where a rename replaces, a hard link does it.
    """
    target, fs = hadoop_path(spark, path)
    draft, _ = hadoop_path(spark, f"{target.getParent().toString()}/.{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            nio = spark._jvm.java.nio.file
            local = [spark._jvm.java.io.File(fs.makeQualified(x).toUri().getPath()).toPath() for x in (target, draft)]
            try:
                nio.Files.createLink(*local)
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                    return False
                raise
        if fs.exists(target):
            return False
        return bool(fs.rename(draft, target))
    finally:
        fs.delete(draft, False)


def text_of(spark: SparkSession, path: str) -> str:
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions of a folder, lowest first."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    found = (re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in fs.listStatus(p))
    return sorted(int(m[1]) for m in found if m)


class Overtaken(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def write(tables: dict[str, DataFrame], path: str, stop: Callable[[str], None], partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Each table to a folder that no version names yet; returns the folders. stop is called before each step (tests break off there)."""
    name, out = uuid.uuid4().hex, {}
    for k, df in tables.items():
        stop(k)
        out[k] = f"data-{name}/{k}"
        df.write.partitionBy(*(partition_by or {}).get(k, [])).parquet(f"{path}/{out[k]}")
    return out


def point(spark: SparkSession, path: str, parts: dict[str, list[str]], base: int | None = None) -> int:
    """Makes the next version of these folders and returns its number; with base, only the one right after it."""
    n = max(numbers(spark, path), default=0) + 1 if base is None else base + 1
    while not made_once(spark, f"{path}/v{n:08d}", json.dumps(parts, sort_keys=True)):
        if base is not None:
            raise Overtaken(f"version {n} of {path}")
        n += 1
    return n


def commit(path: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, stop: Callable[[str], None] = lambda at: None) -> int:
    """Writes all tables as the next version, in place of what was there, and returns its number."""
    spark = next(iter(tables.values())).sparkSession
    made = write(tables, path, stop, partition_by)
    stop("pointer")
    return point(spark, path, {k: [v] for k, v in made.items()})


def pointer(spark: SparkSession, path: str, version: int | None = None) -> dict[str, list[str]]:
    known = numbers(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}")
    return json.loads(text_of(spark, f"{path}/v{version or known[-1]:08d}"))


def current(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last version, or of a given one."""
    read = spark.read.option("mergeSchema", "true")
    return {k: read.parquet(*[f"{path}/{x}" for x in parts]) for k, parts in pointer(spark, path, version).items()}


def append(path: str, tables: dict[str, DataFrame], keys: dict[str, list[str]], stop: Callable[[str], None] = lambda at: None, tries: int = 10) -> int:
    """Commits the rows of tables beside those of the last version; rows of a key that is there already give way to the new ones.

    So a load that runs again leaves what one run leaves. Only those folders of earlier commits that hold such keys are
    written anew; of a table without a key, rows that are there already aren't added. If another writer commits meanwhile,
    all is worked out again on what it left.
    """
    spark = next(iter(tables.values())).sparkSession
    for _ in range(tries):
        base = max(numbers(spark, path), default=0)
        parts = {k: list(v) for k, v in pointer(spark, path, base).items()} if base else {}
        new = dict(tables)
        for k, df in tables.items():
            for at in list(parts.get(k, [])):
                old = spark.read.parquet(f"{path}/{at}")
                if on := keys.get(k):
                    fresh = df.select(*on).distinct()
                    if not old.join(fresh, on, "left_semi").isEmpty():
                        parts[k].remove(at)
                        new[f"{k}-{len(new)}"] = old.join(fresh, on, "left_anti")
                else:
                    new[k] = new[k].exceptAll(old.select(*df.columns))
        made = write(new, path, stop)
        for k, at in made.items():
            parts.setdefault(k if k in tables else k.rpartition("-")[0], []).append(at)
        stop("pointer")
        try:
            return point(spark, path, parts, base)
        except Overtaken:
            continue
    raise Overtaken(f"{path}, {tries} times")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the last keep versions, and data that none of these names, as a broken run leaves; no commit may be under way. Returns folders deleted."""
    known = numbers(spark, path)
    kept = {x.split("/")[0] for n in known[-keep:] for parts in pointer(spark, path, n).values() for x in parts}
    p, fs = hadoop_path(spark, path)
    for n in known[:-keep]:
        fs.delete(hadoop_path(spark, f"{path}/v{n:08d}")[0], False)
    gone = 0
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("data-") and name not in kept:
            gone += bool(fs.delete(s.getPath(), True))
    return gone
