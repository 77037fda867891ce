"""Reproducible sample that stays stable while the data grow.

Method: a persisted selection ledger. It holds every key it has ever seen, with the step in
which the key arrived and whether it was selected. A run joins the present keys with the
ledger; what the ledger holds keeps its verdict for good, whatever happens to the records.
The unseen keys arrive in steps, one for each day of their arrival date, which follow the
ledger's last step however old the dates are. The growth of each step raises the quota to
ceil(rate * keys seen), and the step's unseen keys of lowest hash fill it.

A run only appends: one folder for each run, readable once it is complete, never written
again. A run that was broken off leaves a folder without its mark of success, which the next
run replaces. Without a ledger (a new path) the steps are replayed from the dates, so that a
table and the same table with records of later days agree on the earlier ones even then.

The result depends on keys, dates and earlier runs alone, never on partitioning or the order
of rows. One run is one pass over the keys: the quotas of all steps are set from the number
of arrivals a step, which is all that comes to the driver (a row a day).

Defined cases: null keys are never selected; repeated keys count once and arrive with their
first record; keys without a readable date belong to the run's first step; an empty table
gives an empty ledger; a rate of 1 keeps every key; a lower rate than before adds no key
until the quota has caught up; keys whose records were deleted stay in the ledger, and are
left out of present(); extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaloom.operators.hash_pick import lowest_by_hash
from actaloom.session import file_system, shared_dir, stored

LEDGER = "sample_key string, step bigint, selected boolean"
SALT = "ledger-v1"


def runs(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """(folders of the complete runs in their order, folder of the next run)."""
    fs, root = file_system(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []
    done = [n for n in names if n.startswith("run=") and fs.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1])]
    after = int(done[-1][4:]) + 1 if done else 0
    return [f"{path}/{n}" for n in done], f"{path}/run={after:08d}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All keys that the ledger has seen, see LEDGER."""
    done, _ = runs(spark, path)
    return spark.read.schema(LEDGER).parquet(*done) if done else spark.createDataFrame([], LEDGER)


def takes(arrived: list[int], seen: int, kept: int, rate: float) -> list[int]:
    """How many keys each step selects, by its number of arrivals."""
    out = []
    for n in arrived:
        seen += n
        take = min(n, max(0, math.ceil(round(rate * seen, 6)) - kept))
        kept += take
        out.append(take)
    return out


def grow(df: DataFrame, key: str, arrival: str | None, rate: float, path: str, salt: str = SALT) -> DataFrame:
    """Takes the keys of df that the ledger at path has not seen into it; returns the whole ledger.

    arrival: column of ISO dates, or None if all unseen keys arrive together.
    """
    spark = df.sparkSession
    done, target = runs(spark, path)
    day = F.unix_date(F.try_to_date(F.substring(F.col(arrival).cast("string"), 1, 10), "yyyy-MM-dd")) if arrival else F.lit(None).cast("int")
    present = df.select(F.col(key).cast("string").alias("sample_key"), day.alias("day")).filter(F.col("sample_key").isNotNull()).groupBy("sample_key").agg(F.min("day").alias("day"))
    past = read_ledger(spark, path)
    unseen = stored((present.join(past.select("sample_key"), "sample_key", "left_anti") if done else present).select("sample_key", F.coalesce("day", F.lit(-(1 << 31))).alias("day")), "arrivals")
    days = unseen.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    if not days:
        return past
    before = past.agg(F.count(F.lit(1)).alias("seen"), F.count_if("selected").alias("kept"), F.max("step").alias("last")).first() if done else (0, 0, None)
    first = 0 if before[2] is None else before[2] + 1
    quota = takes([r["n"] for r in days], before[0], before[1], rate)
    steps = spark.createDataFrame([(r["day"], first + k, t) for k, (r, t) in enumerate(zip(days, quota))], "day int, step bigint, take bigint")
    picked = lowest_by_hash(unseen, "sample_key", steps, "day", salt, bins=256).select("sample_key", F.lit(True).alias("selected"))
    rows = unseen.join(F.broadcast(steps.select("day", "step")), "day")  # a row a day
    rows.join(picked, "sample_key", "left").select("sample_key", "step", F.coalesce("selected", F.lit(False)).alias("selected")).write.mode("overwrite").parquet(target)
    return read_ledger(spark, path)


def present(ledger: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(sample_key, step): the selected keys that df still has."""
    keys = df.select(F.col(key).cast("string").alias("sample_key"))
    return ledger.filter("selected").select("sample_key", "step").join(keys, "sample_key", "left_semi")


def ledger_path(spark: SparkSession, *names: object) -> str:
    """The ledger of a table in the shared folder, the same in every session that shares it.

    actaloom.ledger.dir names another folder for all ledgers.
    """
    root = spark.conf.get("actaloom.ledger.dir", None) or f"{shared_dir(spark)}/ledgers"
    return f"{root}/{hashlib.sha256(repr(names).encode()).hexdigest()[:24]}"
