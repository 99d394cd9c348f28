"""Snapshots of a set of tables: backup with counts and checksums, verification, restore by a pointer, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
COLUMNS = "name string, n_rows bigint, checksum bigint, n_columns int"


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values; maps, which have no hash, by their sorted entries."""
    return F.xxhash64(*(F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if f.dataType.typeName() ==
            "map" else F.col(f"`{f.name}`") for f in df.schema.fields)) if df.columns else F.lit(0).cast("bigint")


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(name, n_rows, checksum, n_columns): the checksum is the xor of all row hashes and their sum modulo 2 ** 40, so it depends on no order and repeated rows count."""
    h = row_hash(df)
    both = F.coalesce(F.bit_xor(h).bitwiseXOR(F.sum(F.pmod(h, F.lit(1 << 40)))), F.lit(0)).cast("bigint")
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), both.alias("checksum"), F.lit(len(df.columns)).alias("n_columns"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def backup(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> DataFrame:
    """Write all tables below ``path`` and, last, the manifest that makes them a backup; each table is written and fingerprinted as written. Gives the manifest."""
    spark = next(iter(tables.values())).sparkSession
    if _exists(spark, f"{path}/{MANIFEST}") and not overwrite:
        raise ValueError(f"backup exists already: {path}")
    told, version = None, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}-{version}")
        one = fingerprint(spark.read.parquet(f"{path}/{name}-{version}"), name).withColumn("folder", F.lit(f"{name}-{version}"))
        told = one if told is None else told.unionByName(one)
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(name, ok, n_rows, found_rows) of the tables of a backup, recomputed."""
    held = spark.read.parquet(f"{path}/{MANIFEST}")
    out = spark.createDataFrame([], "name string, ok boolean, n_rows bigint, found_rows bigint")
    for r in held.collect():  # one row a table
        if not _exists(spark, f"{path}/{r['folder']}"):
            one = spark.createDataFrame([(r["name"], False, r["n_rows"], 0)], out.schema)
        else:
            found = fingerprint(spark.read.parquet(f"{path}/{r['folder']}"), r["name"])
            one = found.select("name", ((F.col("n_rows") == r["n_rows"]) & (F.col("checksum") == r["checksum"])).alias("ok"),
                F.lit(r["n_rows"]).cast("bigint").alias("n_rows"), F.col("n_rows").alias("found_rows"))
        out = out.unionByName(one)
    return out


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup, if all of them verify."""
    bad = [r["name"] for r in verify(spark, path).where("NOT ok").collect()]
    if bad:
        raise ValueError(f"backup fails its check: {', '.join(sorted(bad))}")
    return {r["name"]: spark.read.parquet(f"{path}/{r['folder']}") for r in spark.read.parquet(f"{path}/{MANIFEST}").collect()}


def exclusions(paths: DataFrame, data_dir: str, *outputs: str) -> DataFrame:
    """``paths`` (path) below the data directory without what a backup writes itself."""
    mine = [p.rstrip("/") for p in outputs]
    out = paths.where(F.startswith("path", F.lit(data_dir.rstrip("/") + "/")))
    for p in mine:
        out = out.where((F.col("path") != p) & ~F.startswith("path", F.lit(p + "/")))
    return out


def compact(spark: SparkSession, path: str, target_bytes: int = 256 << 20) -> int:
    """Rewrite a Parquet table in files of about ``target_bytes`` beside the old ones and put them in place; the number of files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    n = max(1, -(-fs.getContentSummary(at).getLength() // target_bytes))
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    spark.read.parquet(path).repartition(int(n)).write.parquet(new.toString())
    if not (fs.rename(at, old) and fs.rename(new, at)):
        raise RuntimeError(f"compacted files of {path} could not be put in place")
    fs.delete(old, True)
    return int(n)
