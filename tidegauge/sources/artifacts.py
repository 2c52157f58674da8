"""Named tables, metrics and models kept between runs. No pickles.

A stored name is a folder of immutable data folders and a row of numbered manifests, small JSON files
that name the data folders of one version. Data are written first and the manifest last, so a reader
sees the version before or the one after, never none or half of one, and a table that is being read
may be replaced, by itself too. A reader is pinned to the data folders of the version it opened.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

METRIC = "run_id string, name string, value double, as_of string"


class OutOfDate(RuntimeError):
    """Another writer published a version first."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path of ``path``, whichever store that names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _manifests(spark: SparkSession, root: str, name: str) -> list[int]:
    fs, path = _files(spark, os.path.join(root, name, "manifests"))
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest_path(root: str, name: str, version: int) -> str:
    return os.path.join(root, name, "manifests", f"{version:09d}.json")


def _read_manifest(spark: SparkSession, root: str, name: str, version: int) -> dict | None:
    """What a version holds; None while its writer has not finished the file."""
    fs, path = _files(spark, _manifest_path(root, name, version))
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def _publish(spark: SparkSession, root: str, name: str, version: int, content: dict) -> None:
    fs, path = _files(spark, _manifest_path(root, name, version))
    try:
        stream = fs.create(path, False)  # fails where the version is there already
    except Exception as e:
        if fs.exists(path):
            raise OutOfDate(f"version {version} of {name} is published") from e
        raise
    try:
        stream.write(bytearray((json.dumps(content) + "\n").encode()))
    finally:
        stream.close()


def current(spark: SparkSession, root: str, name: str) -> tuple[int, dict] | None:
    """Number and content of the newest published version, None where there is none."""
    for version in reversed(_manifests(spark, root, name)):
        content = _read_manifest(spark, root, name, version)
        if content is not None:
            return version, content
    return None


def _write(df: DataFrame, root: str, name: str, kept: list[str], version: int) -> int:
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(os.path.join(root, name, folder))
    _publish(df.sparkSession, root, name, version, {"folders": [*kept, folder]})
    return version


def save_artifact(df: DataFrame, root: str, name: str, expect: int | None = None) -> int:
    """Publish a table under its name, in place of an earlier one, and give its version.

    ``df`` may read the table that it replaces. With ``expect`` the newest version must still be that
    one (0: none), else :class:`OutOfDate` is raised and what is stored stays; without it the last
    writer wins.
    """
    spark = df.sparkSession
    while True:
        found = current(spark, root, name)
        newest = max([found[0] if found else 0, *_manifests(spark, root, name)[-1:]])
        if expect is not None and (found[0] if found else 0) != expect:
            raise OutOfDate(f"{name} is at version {newest}, not {expect}")
        try:
            return _write(df, root, name, [], newest + 1)
        except OutOfDate:
            if expect is not None:
                raise


def append_artifact(df: DataFrame, root: str, name: str) -> int:
    """Publish a version with the rows of the one before and those of ``df``; nothing is rewritten."""
    spark = df.sparkSession
    while True:
        found = current(spark, root, name)
        newest = max([found[0] if found else 0, *_manifests(spark, root, name)[-1:]])
        try:
            return _write(df, root, name, found[1]["folders"] if found else [], newest + 1)
        except OutOfDate:
            continue  # rows of another writer are there now; both stay


def has_artifact(spark: SparkSession, root: str, name: str) -> bool:
    return current(spark, root, name) is not None


def in_sync(spark: SparkSession, root: str, name: str, version: int) -> bool:
    """Whether a copy taken at ``version`` is still what is stored."""
    found = current(spark, root, name)
    return found is not None and found[0] == version


def load_artifact(spark: SparkSession, root: str, name: str, default: DataFrame | None = None,
                  version: int | None = None) -> DataFrame:
    """Table stored under a name, its newest version or the one asked for, or ``default`` when it was
    never saved. The frame goes on reading that version whatever is published after it."""
    if version is None:
        found = current(spark, root, name)
        if found is None:
            if default is not None:
                return default
            raise FileNotFoundError(f"no artifact {name} in {root}")
        content = found[1]
    else:
        content = _read_manifest(spark, root, name, version)
    return spark.read.parquet(*(os.path.join(root, name, f) for f in content["folders"]))


class Cache:
    """Tables that are in use, read anew only where the stored version has moved on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.held = spark, root, {}

    def load(self, name: str) -> DataFrame:
        found = current(self.spark, self.root, name)
        if found is None:
            raise FileNotFoundError(f"no artifact {name} in {self.root}")
        if name not in self.held or self.held[name][0] != found[0]:
            self.held[name] = found[0], load_artifact(self.spark, self.root, name, version=found[0])
        return self.held[name][1]


def log_metrics(spark: SparkSession, root: str, run_id: str, values: dict[str, float], as_of: str) -> None:
    """Append the metrics of a run in one write; ``as_of`` is given by the caller, never read from the clock."""
    rows = spark.createDataFrame([(run_id, n, float(v), as_of) for n, v in values.items()], METRIC)
    append_artifact(rows.withColumn("ts", F.to_timestamp("as_of")).drop("as_of").coalesce(1), root, "metrics")


def log_metric(spark: SparkSession, root: str, run_id: str, name: str, value: float, as_of: str) -> None:
    log_metrics(spark, root, run_id, {name: value}, as_of)


def save_model(model: PipelineModel, root: str, name: str, stage: str = "None") -> int:
    """Publish a fitted pipeline by name and stage; earlier versions stay for those who loaded them."""
    spark = SparkSession.active()
    stored = os.path.join("models", name, stage)
    folder = f"data-{uuid.uuid4().hex}"
    model.write().save(os.path.join(root, stored, folder))
    while True:
        newest = max([0, *_manifests(spark, root, stored)[-1:]])
        try:
            _publish(spark, root, stored, newest + 1, {"folders": [folder]})
            return newest + 1
        except OutOfDate:
            continue


def load_model(root: str, name: str, stage: str = "None") -> PipelineModel:
    stored = os.path.join("models", name, stage)
    found = current(SparkSession.active(), root, stored)
    if found is None:
        raise FileNotFoundError(f"no model {name} at stage {stage} in {root}")
    return PipelineModel.load(os.path.join(root, stored, found[1]["folders"][0]))


def compact(spark: SparkSession, root: str, name: str) -> int:
    """Publish the rows of the newest version from one folder instead of many."""
    version, _ = current(spark, root, name)
    return save_artifact(load_artifact(spark, root, name, version=version), root, name, expect=version)
