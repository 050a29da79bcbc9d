"""A store of components with versions: metadata, posteriors, observations and projections that are replaced together.

Tables are written to folders of their own; a manifest (a small JSON file, one per version) names the folders that make up a version. A writer writes its tables first and
then moves the next manifest to its place, and readers take the last manifest they find: they see all of a replacement or nothing of it, and an old version stays readable until
``vacuum``. One writer at a time; a second one that comes between fails and changes nothing. Files are handled by Hadoop's file system, so that any store Spark reads will do.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("posteriors", "observations", "projections")
MANIFEST = "manifest-{:08d}.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a store, oldest first; empty if there is none."""
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    known = versions(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return 0, {}
    if version not in known:
        raise ValueError(f"the store has no version {version}")
    text = spark.read.text(f"{root}/{MANIFEST.format(version)}", wholetext=True).first()[0]
    return version, json.loads(text)


def _facts(metadata: Mapping[str, object]) -> dict[str, object]:
    """Metadata without what is missing or not finite."""
    return {k: v for k, v in metadata.items() if v is not None and not (isinstance(v, float) and not math.isfinite(v))}


def replace(spark: SparkSession, root: str, component: str, metadata: Mapping[str, object] | None = None, posteriors: DataFrame | None = None, observations: DataFrame | None = None, projections: DataFrame | None = None) -> int:
    """Replace what is given of a component, all in one new version, whose number is returned.

    ``projections`` has a column ``scenario``; scenarios that it does not have stay. Other kinds and metadata that are not given stay.
    """
    before, content = _manifest(spark, root)
    entry = {"metadata": {}, "posteriors": [], "observations": [], "projections": {}} | content.get(component, {})
    if metadata is not None:
        entry["metadata"] = _facts(metadata)
    for kind, table in (("posteriors", posteriors), ("observations", observations), ("projections", projections)):
        if table is None:
            continue
        folder = f"data/{component}/{kind}-{uuid.uuid4().hex[:12]}"
        if kind != "projections":
            table.write.option("compression", "zstd").parquet(f"{root}/{folder}")
            entry[kind] = [folder]
            continue
        table.write.option("compression", "zstd").partitionBy("scenario").parquet(f"{root}/{folder}")
        written = [r[0] for r in spark.read.parquet(f"{root}/{folder}").select(F.col("scenario").cast("string")).distinct().collect()]
        entry[kind] = entry[kind] | dict.fromkeys(written, folder)
    return _commit(spark, root, before + 1, content | {component: entry})


def _commit(spark: SparkSession, root: str, version: int, content: dict) -> int:
    final, fs = _fs(spark, f"{root}/{MANIFEST.format(version)}")
    part, _ = _fs(spark, f"{root}/.part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(part, final):
        fs.delete(part, False)
        raise RuntimeError(f"version {version} of the store was written by another writer")
    return version


def components(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(component, kind, scenario) of what a version has."""
    _, content = _manifest(spark, root, version)
    rows = [(c, k, s) for c, e in content.items() for k in KINDS for s in (sorted(e[k]) if k == "projections" else [None] * len(e[k]))]
    return spark.createDataFrame(rows, "component string, kind string, scenario string")


def metadata(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(component, key, value) of a version, values as JSON."""
    _, content = _manifest(spark, root, version)
    return spark.createDataFrame([(c, k, json.dumps(v)) for c, e in content.items() for k, v in e["metadata"].items()], "component string, key string, value string")


def load(spark: SparkSession, root: str, component: str, kind: str, version: int | None = None) -> DataFrame:
    """A table of a component in a version."""
    _, content = _manifest(spark, root, version)
    entry = content.get(component)
    if entry is None or not entry[kind]:
        raise KeyError(f"the store has no {kind} of {component}; it has {', '.join(sorted(content)) or 'nothing'}")
    if kind != "projections":
        return spark.read.parquet(*[f"{root}/{p}" for p in entry[kind]])
    by_folder: dict[str, list[str]] = {}
    for scenario, folder in entry[kind].items():
        by_folder.setdefault(folder, []).append(scenario)
    # a folder may have scenarios that a later version took from elsewhere
    parts = [spark.read.parquet(f"{root}/{folder}").withColumn("scenario", F.col("scenario").cast("string")).filter(F.col("scenario").isin(own)) for folder, own in sorted(by_folder.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def projections(spark: SparkSession, root: str, names: list[str] | None = None, version: int | None = None) -> DataFrame:
    """Projections of components with a column ``component``; one whose metadata says ``scenario_independent`` is repeated, from its first scenario, for all scenarios that
    other components have."""
    version, content = _manifest(spark, root, version)
    names = [n for n in (names or sorted(content)) if content[n]["projections"]]
    every = sorted({s for n in names for s in content[n]["projections"]})
    out = None
    for name in names:
        own = load(spark, root, name, "projections", version).withColumn("component", F.lit(name))
        if content[name]["metadata"].get("scenario_independent"):
            first = own.filter(F.col("scenario") == min(content[name]["projections"]))
            own = first.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in every])))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise KeyError("the store has no projections")
    return out


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete all versions but the last, and the folders that it does not name; the number of folders deleted. Readers of old versions must be done."""
    last, content = _manifest(spark, root)
    used = {p for e in content.values() for p in [*e["posteriors"], *e["observations"], *e["projections"].values()]}
    for v in versions(spark, root):
        if v != last:
            p, fs = _fs(spark, f"{root}/{MANIFEST.format(v)}")
            fs.delete(p, False)
    n = 0
    data, fs = _fs(spark, f"{root}/data")
    for c in fs.listStatus(data) if fs.exists(data) else []:
        for f in fs.listStatus(c.getPath()):
            if f"data/{c.getPath().getName()}/{f.getPath().getName()}" not in used:
                fs.delete(f.getPath(), True)
                n += 1
    return n
