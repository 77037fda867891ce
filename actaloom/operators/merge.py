"""Merging of versions: three-way merge, incremental status, retry on conflict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): local changes over the remote's, key by key.

    A key that local deleted since the base is gone, though remote still has it; a key that
    remote alone has and the base had not is kept; where local has the key, its value holds
    if it changed since the base, else the remote's.
    """
    b, mine, r = (x.select(F.col(key), F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for x, n in ((base, "b"), (local, "l"), (remote, "r")))
    full = b.join(mine, key, "full_outer").join(r, key, "full_outer")
    has = {n: F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in "blr"}
    keep = has["l"] & (has["r"] | ~has["b"] | ~F.col("l").eqNullSafe(F.col("b"))) | (~has["l"] & has["r"] & ~has["b"])
    merged = F.when(has["l"] & ~(has["b"] & F.col("l").eqNullSafe(F.col("b")) & has["r"]), F.col("l")).otherwise(F.col("r"))
    return full.filter(keep).select(key, merged.alias(value))


def merge_records(local: DataFrame, remote: DataFrame, key: str, stamp: str) -> DataFrame:
    """The later record of each key as a whole; on equal stamps local's. Both have the same columns."""
    rest = [c for c in local.columns if c != key]
    rows = local.withColumn("_mine", F.lit(1)).unionByName(remote.withColumn("_mine", F.lit(0)))
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(stamp), F.col("_mine"), F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(key, *(F.col(f"_m._row.{c}").alias(c) for c in rest))


def incremental_status(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): written, unchanged, protected (changed content is reported, never overwritten), absent."""
    a = stored.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_a"))
    b = incoming.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "written").when(F.col("_b").isNull(), "absent").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("protected")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def merge_documents(base: DataFrame, local: DataFrame, remote: DataFrame, doc: str, field: str, value: str) -> DataFrame:
    """(doc, field, value): documents merged field by field; value is a JSON text, null for JSON null.

    Plain fields follow three_way. A field whose values are arrays of records (objects with an
    id) is merged record by record: local's record replaces the remote's as a whole unless it is
    older by its updatedAt; a record that local deleted since the base is gone, one that the
    remote alone added stays; so is one that the remote deleted and local did not touch. The
    remote's order comes first, then what local added. A document's own records meet in one
    row, as the document itself does.
    """
    sides = {"b": base, "l": local, "r": remote}
    rows = {n: x.select(F.struct(F.col(doc).alias("doc"), F.col(field).alias("field")).alias("k"), F.col(value).alias("v")) for n, x in sides.items()}
    split = F.from_json("v", "array<string>")
    is_list = F.startswith(F.ltrim("v"), F.lit("[")) & F.coalesce(F.forall(split, lambda x: F.get_json_object(x, "$.id").isNotNull()), F.lit(False))
    lists = None
    for x in rows.values():
        one = x.filter(is_list).select("k")
        lists = one if lists is None else lists.union(one)
    lists = lists.distinct()
    plain = three_way(*(x.join(lists, "k", "left_anti") for x in rows.values()), "k", "v")
    records = {}
    for n, x in rows.items():
        each = x.join(lists, "k", "left_semi").select("k", F.posexplode(split).alias("pos", "rec"))
        best = each.withColumn("id", F.get_json_object("rec", "$.id")).groupBy("k", "id").agg(F.max_by(F.struct("pos", "rec"), "pos").alias(n))
        records[n] = best.withColumn(f"{n}_at", F.get_json_object(F.col(f"{n}.rec"), "$.updatedAt"))
    full = records["r"].join(records["l"], ["k", "id"], "full_outer").join(records["b"], ["k", "id"], "full_outer")
    has = {n: F.col(n).isNotNull() for n in "blr"}
    keep = has["l"] & (has["r"] | ~has["b"] | ~F.col("l.rec").eqNullSafe(F.col("b.rec"))) | ~has["l"] & has["r"] & ~has["b"]
    older = has["r"] & (F.col("l_at") < F.col("r_at"))
    chosen = F.when(has["l"] & ~F.coalesce(older, F.lit(False)), F.col("l.rec")).otherwise(F.coalesce(F.col("r.rec"), F.col("l.rec")))
    place = F.when(has["r"], F.struct(F.lit(0).alias("new"), F.col("r.pos").alias("pos"))).otherwise(F.struct(F.lit(1).alias("new"), F.col("l.pos").alias("pos")))
    gathered = full.filter(keep).groupBy("k").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), chosen.alias("rec")))).alias("all"))
    fields = lists.join(rows["l"].select("k", F.lit(True).alias("here")), "k", "left").join(gathered, "k", "left").filter("here or all is not null")
    arrays = fields.select("k", F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<place:struct<new:int,pos:int>,rec:string>>")), lambda x: x["rec"]), ","), F.lit("]")).alias("v"))
    return plain.unionByName(arrays).select(F.col("k.doc").alias(doc), F.col("k.field").alias(field), F.col("v").alias(value))


class Conflict(Exception):
    """The stored version is newer than the one that a write is based on."""


def save_with_retry(read: Callable[[], tuple[object, int]], merge: Callable[[object], object], write: Callable[[object, int], None]) -> object:
    """Reads, merges and writes on the version read; after one conflict it does so once more, a second one is raised."""
    for last in (False, True):
        remote, version = read()
        merged = merge(remote)
        try:
            write(merged, version)
            return merged
        except Conflict:
            if last:
                raise
    raise AssertionError
