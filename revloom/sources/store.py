"""A table store with one commit point, renewed repository by repository.

Layout: ``<root>/data/<table>/version=<n>/repo=<name>`` and ``<root>/manifest/version=<n>``. A manifest says for every
repository which version holds its rows and from what it was made (its fingerprint). Files of a version are written
first and never changed; its manifest is written last, by one task whose commit makes the version valid. A run that
ends in between leaves files that no manifest names: readers go on with the version before.

:func:`refresh` compares fingerprints and builds only repositories that are new or have changed. Readers join with the
manifest on the partition columns, so Spark prunes folders of other versions. :func:`vacuum` removes versions that the
latest manifest does not name.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from revloom.operators.clean import to_schema
from revloom.plans.runtime import remove_path
from revloom.sources.tables import OPTIONAL, REQUIRED, History

MANIFEST = "repo string, data_version long, fingerprint string"
_KEYS = {"commits": "hash", "branches": "full_name", "tags": "tag_name"}


def dump_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """(repo, fingerprint) of a folder of dumps, from the names, lengths and times of its files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        "path", "length", F.unix_micros("modificationTime").alias("time"))
    repo = F.url_decode(F.regexp_extract("path", r"/repo=([^/]*)/", 1))
    # a sum does not depend on the order of files
    mark = F.sum(F.xxhash64(F.regexp_replace("path", "^.*/([^/]+/repo=)", "$1"), "length", "time").cast("decimal(38,0)"))
    return files.select(repo.alias("repo"), "path", "length", "time").filter(F.col("repo") != "").groupBy("repo").agg(
        F.concat_ws("-", F.count(F.lit(1)).cast("string"), mark.cast("string")).alias("fingerprint"))


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Versions with a finished manifest, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = []
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and store.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """(repo, data_version, fingerprint) of the latest valid version, None before the first."""
    versions = _versions(spark, root)
    if not versions:
        return None
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={versions[-1]}")


def _next_version(spark: SparkSession, root: str) -> int:
    """Above all versions that were begun, finished or not: files of a failed run are never taken up."""
    begun = [0, *_versions(spark, root)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in (*REQUIRED, *OPTIONAL):
        folder = path(f"{root}/data/{name}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(folder):
            begun += [int(s.getPath().getName().removeprefix("version=")) for s in store.listStatus(folder)
                      if s.getPath().getName().startswith("version=")]
    return max(begun) + 1


def refresh(spark: SparkSession, root: str, fingerprints: DataFrame,
            build: Callable[[DataFrame], History]) -> DataFrame:
    """Bring the store up to date and return the repositories that were written (repo).

    ``fingerprints`` (repo, fingerprint) names every repository that the store shall have. ``build`` gets those that
    are new or changed and returns their tables; rows of other repositories are left out. Tables that the history
    lacks have no rows for these repositories.
    """
    root = root.rstrip("/")
    wanted = fingerprints.groupBy("repo").agg(F.max("fingerprint").alias("fingerprint"))
    known = manifest(spark, root)
    if known is None:
        known = spark.createDataFrame([], MANIFEST)
    version = _next_version(spark, root)
    plan = wanted.join(known.withColumnRenamed("fingerprint", "_was"), "repo", "left").select(
        "repo", "fingerprint", F.when(F.col("_was") == F.col("fingerprint"), F.col("data_version")).alias("_kept"))
    # written before the tables, but no manifest yet: the decision must not change when dumps do
    plan.coalesce(1).write.parquet(f"{root}/plan/version={version}")
    plan = spark.read.schema("repo string, fingerprint string, _kept long").parquet(f"{root}/plan/version={version}")
    changed = plan.filter(F.col("_kept").isNull()).select("repo")
    if not changed.isEmpty():
        history = build(changed)
        for name in (*REQUIRED, *OPTIONAL):
            table = getattr(history, name)
            if table is not None:
                key = _KEYS.get(name, "commit_hash")
                (table.join(changed, "repo", "left_semi").repartitionByRange("repo", key)
                 .sortWithinPartitions("repo", key).write.partitionBy("repo")
                 .parquet(f"{root}/data/{name}/version={version}"))
    # the commit point: one file, one task
    plan.select("repo", F.coalesce("_kept", F.lit(version)).alias("data_version"), "fingerprint").coalesce(1).write.parquet(
        f"{root}/manifest/version={version}")
    return changed


def read_store(spark: SparkSession, root: str) -> History | None:
    """The tables of the latest valid version, None before the first. Lazy; files that it reads are never changed."""
    root = root.rstrip("/")
    named = manifest(spark, root)
    if named is None:
        return None
    named = named.select("repo", F.col("data_version").alias("version"))
    versions = [r.version for r in named.select("version").distinct().collect()]  # at most the runs so far
    path, found = spark._jvm.org.apache.hadoop.fs.Path, {}
    for name, schema in (REQUIRED | OPTIONAL).items():
        store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [f"{root}/data/{name}/version={v}" for v in versions
                 if store.exists(path(f"{root}/data/{name}/version={v}/_SUCCESS"))]
        if not there:
            continue
        stored = spark.read.option("basePath", f"{root}/data/{name}").option("mergeSchema", "true").parquet(*there)
        if "repo" not in stored.columns:  # nothing but empty tables
            continue
        # repository names stay text even when they look like numbers
        typed = T.StructType([T.StructField(f.name, {"repo": T.StringType(), "version": T.LongType()}.get(f.name, f.dataType))
                              for f in stored.schema.fields])
        rows = spark.read.schema(typed).option("basePath", f"{root}/data/{name}").parquet(*there).join(
            named, ["repo", "version"], "left_semi").drop("version")
        known = rows.schema if schema is None else T.StructType([f for f in schema.fields if f.name in rows.columns])
        found[name] = to_schema(rows, known)
    return History(**found)


def vacuum(spark: SparkSession, root: str) -> list[int]:
    """Remove the files of versions that the latest manifest does not name, and older manifests; returns them."""
    root = root.rstrip("/")
    versions, named = _versions(spark, root), manifest(spark, root)
    if named is None:
        return []
    kept = {r.data_version for r in named.select("data_version").distinct().collect()}
    gone = [v for v in range(1, versions[-1]) if v not in kept]
    for v in range(1, versions[-1]):
        if v in gone:
            for name in (*REQUIRED, *OPTIONAL):
                remove_path(spark, f"{root}/data/{name}/version={v}")
        for kind in ("plan", "manifest"):
            remove_path(spark, f"{root}/{kind}/version={v}")
    return gone
