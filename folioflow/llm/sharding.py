"""Sharding by fixed virtual slots.

Records hash into thousands of slots that never change; a small versioned map says which shard holds a slot, and
rebalancing edits the map instead of rehashing records. The map is a folder with a Parquet table of edits a version (``save_edits``,
``load_map``): version 1 names every slot, each later one only the slots that moved, and any version can be read again. A corpus is sharded by the
stored map (``shard_documents``); a next version is written only if its loads leave the tolerance and the edits lower the fullest shard's.
Only the slot totals (at most ``slots`` rows, whatever the corpus) are windowed on one task or broadcast.

Defined results: a record with a null key hashes by its text, so records without a key spread (equal texts stay together, null texts hash
like the empty string); a null or empty text has 0 bytes; repeated rows go to the
same slot and each counts its bytes; equal slot sizes are ordered by slot number; an empty table gives an empty result
and a map in which slot ``s`` stays on shard ``s % shards``; columns of the input named slot, shard or map_version are replaced.
A version is written once: writing it again, or one that does not follow the last, raises, so of two writers one fails and has to plan anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import _file_system, hash01, hash01_sql, materialize

SLOTS, SHARDS, TOLERANCE = 4096, 64, 1.02


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.floor(hash01(key, "slot:") * slots).cast("int")


def slot_key(key: str = "doc_id") -> Column:
    """The key, or what stands for it in a record without one."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5("text")))


def slot_bytes(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """(slot, bytes, records) of the slots in use; one partial aggregate per task, at most ``slots`` rows shuffled from each."""
    return docs.groupBy(slot_of(slot_key(key), slots).alias("slot")).agg(F.coalesce(F.sum(F.octet_length("text")),
            F.lit(0)).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("records"))


def initial_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: slot modulo shards."""
    return spark.range(0, slots, 1, 1).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored at ``path``, rising; none if there is no map yet. A version whose write did not finish is not one."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    found = [int(n.partition("=")[2]) for n in names if n.startswith("version=")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(v for v in found if fs.exists(done(f"{path}/version={v}/_SUCCESS")))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, slot, shard) edits up to ``version``, or all of them."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} of a slot map at {path}; there are {known}")
    wanted = [v for v in known if version is None or v <= version]
    one = lambda v: spark.read.schema("slot int, shard int").parquet(f"{path}/version={v}").select(F.lit(v).alias("version"), "slot", "shard")
    out = one(wanted[0])
    for v in wanted[1:]:
        out = out.unionByName(one(v))
    return out


def save_edits(edits: DataFrame, path: str) -> int:
    """Store edits (version, slot, shard) of one new version; its number. At most ``slots`` rows, so one file."""
    spark = edits.sparkSession
    told = edits.agg(F.min("version"), F.max("version"), F.count(F.lit(1)), F.count_distinct("slot")).first()
    last = max(versions(spark, path), default=0)
    if told[0] != told[1] or told[0] != last + 1 or told[2] != told[3]:
        raise ValueError(f"edits must be of version {last + 1} alone and name a slot once, not {tuple(told)}")
    edits.select("slot", "shard").coalesce(1).write.mode("error").parquet(f"{path}/version={told[0]}")
    return told[0]


def current(map_: DataFrame, version: int | None = None) -> DataFrame:
    """The map as of ``version``: of every slot, its latest edit."""
    edits = map_ if version is None else map_.where(F.col("version") <= version)
    return edits.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("map_version"))


def rebalance(map_: DataFrame, loads: DataFrame, version: int, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The edits of the next version: slots beyond a shard's tolerated share move to shards with room.

    In every shard the largest slots stay until their running total passes ``tolerance`` times the even share (the first
    always stays). The rest move, largest first, along the room left on the other shards in shard order.
    """
    held = current(map_).join(F.broadcast(loads), "slot", "left").select("slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = Window.partitionBy()
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    marked = held.withColumn("total",
        F.sum("bytes").over(total)).withColumns({"run": F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding,
        0)), "n": F.row_number().over(by_size)})
    moves = (F.col("n") > 1) & (F.col("run") * shards > F.col("total") * tolerance) & (F.col("bytes") > 0)
    marked = marked.withColumn("moves", moves)
    share = F.max("total") / F.lit(float(shards))
    kept = marked.groupBy("shard").agg(share.alias("share"), F.coalesce(F.sum(F.when(~F.col("moves"), F.col("bytes"))), F.lit(0)).alias("kept"))
    room = kept.select("shard", F.greatest(F.lit(0.0), F.col("share") - F.col("kept")).alias("room"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("hi", F.sum("room").over(upto)).withColumn("all_room",
        F.sum("room").over(total)).select(F.col("shard").alias("to"), (F.col("hi") - F.col("room")).alias("lo"), "hi",
        "all_room").where("hi > lo")
    moving = Window.orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = marked.where("moves").withColumn("end", F.sum("bytes").over(moving)).withColumn("all_moved",
        F.sum("bytes").over(total)).withColumn("mid", (F.col("end") - F.col("bytes") / 2) / F.col("all_moved"))
    hit = moved.join(F.broadcast(room), (F.col("mid") * F.col("all_room") >= F.col("lo")) & (F.col("mid") * F.col("all_room") < F.col("hi")))
    return hit.select(F.lit(version).alias("version"), "slot", F.col("to").alias("shard"))


def assign(docs: DataFrame, map_: DataFrame, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with slot, shard and map_version; the map is broadcast, its size is the number of slots."""
    rest = docs.drop("slot", "shard", "map_version").withColumn("slot", slot_of(slot_key(key), slots))
    return rest.join(F.broadcast(current(map_)), "slot").select(*rest.columns, "shard", "map_version")


def plan(docs: DataFrame, map_path: str, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The stored map for a corpus: made if there is none, edited in a next version if the corpus' loads call for it."""
    spark = docs.sparkSession
    if not versions(spark, map_path):
        save_edits(initial_map(spark, slots, shards), map_path)
    held = load_map(spark, map_path)
    known = held.agg(F.count_distinct("slot"), F.max("shard"), F.max("version")).first()
    if known[0] != slots or known[1] >= shards:
        raise ValueError(f"the map at {map_path} has {known[0]} slots and shards up to {known[1]}, not {slots} and {shards}")
    loads = materialize(slot_bytes(docs, slots), "slot-bytes")
    edits = materialize(rebalance(held, loads, known[2] + 1, shards, tolerance), "slot-edits")
    if not edits.isEmpty() and worst_load(held.unionByName(edits), loads) < worst_load(held, loads):
        save_edits(edits, map_path)
    return load_map(spark, map_path)


def worst_load(map_: DataFrame, loads: DataFrame) -> int:
    """Bytes of the fullest shard."""
    held = current(map_).join(F.broadcast(loads), "slot").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    return held.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]


def new_map_path(spark: SparkSession) -> str:
    """A place for a map of its own below the shared folder."""
    return f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = TOLERANCE, map_path: str | None = None) -> DataFrame:
    """``docs`` by the map stored at ``map_path``. Without a path the corpus gets a map of its own."""
    return assign(docs, plan(docs, map_path or new_map_path(docs.sparkSession), slots, shards, tolerance), slots)


def oracle(slots: int = SLOTS, shards: int = SHARDS, tolerance: float = TOLERANCE) -> str:
    key = "coalesce(doc_id::varchar, 'text:' || md5(text))"
    slot = f"floor({hash01_sql(key, 'slot:')} * {slots})::int"
    return f"""
WITH loads AS (SELECT {slot} AS slot, sum(strlen(text))::bigint AS bytes FROM documents GROUP BY 1),
held AS (SELECT r.range::int AS slot, (r.range % {shards})::int AS shard, coalesce(l.bytes, 0) AS bytes FROM range({slots}) r LEFT JOIN loads l ON l.slot = r.range),
marked AS (SELECT *, sum(bytes) OVER () AS total, row_number() OVER w AS n, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM held WINDOW w AS (PARTITION BY shard ORDER BY bytes DESC, slot)),
told AS (SELECT *, n > 1 AND run * {shards} > total * {tolerance}::double AND bytes > 0 AS moves FROM marked),
room AS (SELECT shard, greatest(0.0::double, max(total)::double / {float(shards)}::double - coalesce(sum(bytes) FILTER (NOT moves), 0)::double) AS room FROM told GROUP BY shard),
lanes AS (SELECT shard AS dest, sum(room) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING) AS hi, room, sum(room) OVER () AS all_room FROM room),
moved AS (SELECT slot, (sum(bytes) OVER (ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING)::double - bytes::double / 2) / (sum(bytes) OVER ())::double AS mid FROM told WHERE moves),
edits AS (SELECT slot, dest FROM moved, lanes WHERE mid * all_room >= hi - room AND mid * all_room < hi AND room > 0),
placed AS (SELECT h.slot, h.shard AS was, coalesce(e.dest, h.shard) AS shard, e.dest IS NOT NULL AS edited, h.bytes FROM held h LEFT JOIN edits e USING (slot)),
better AS (SELECT (SELECT max(b) FROM (SELECT sum(bytes) AS b FROM placed GROUP BY shard)) < (SELECT max(b) FROM (SELECT sum(bytes) AS b FROM placed GROUP BY was)) AS yes),
final AS (SELECT slot, CASE WHEN yes THEN shard ELSE was END AS shard, CASE WHEN yes AND edited THEN 2 ELSE 1 END AS map_version FROM placed, better)
SELECT d.doc_id, f.slot, f.shard, f.map_version FROM documents d JOIN final f ON f.slot = {slot.replace('doc_id', 'd.doc_id').replace('md5(text)', 'md5(d.text)')}
"""
