"""Sample that matches target category proportions.

Method: swap repair. Records are grouped by category signature (the set of targeted
categories they carry). A random sample that meets the floors is written as a count for
each signature; counts are exchanged between signatures while that lowers the deviation
from the targets; the final counts are materialised by lowest hash in each signature.

The deviation is the sum over the categories of (count - goal)^2 / goal, so that what cannot
be met is shared in proportion, not left to one category. The report comes from the
repaired counts: a goal is unmet if the repair ends below it although the sample has room
for all goals.

The driver sees counts by signature only: at most 2^(number of targets), and as many as
there are targets for records of one category. An exchange is the best of all pairs of
signatures, found block by block, so the driver holds a few blocks at a time. Defined cases:
records without key or category are left out; repeated keys count once; a key with several
categories counts for each; categories without a target may fill the sample but have no
goal; repeated targets count by their largest share and floor; unknown targets and empty
tables give unmet report rows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.operators.hash_pick import lowest_by_hash
from actaloom.session import stored

REPORT = "category string, available bigint, wanted bigint, sampled bigint, attainable boolean"
#: Signatures of one block of the exchange.
BLOCK = 1024


def signatures(df: DataFrame, key: str, category: str, targets: list[str]) -> DataFrame:
    """(rec_key, signature): one row a key; the signature joins its targeted categories in order, "" for others."""
    cat = F.col(category).cast("string")
    return (
        df.select(F.col(key).cast("string").alias("rec_key"), cat.alias("_c"))
        .filter(F.col("rec_key").isNotNull() & F.col("_c").isNotNull())
        .groupBy("rec_key")
        .agg(F.sort_array(F.collect_set(F.when(F.col("_c").isin(targets), F.col("_c")))).alias("_s"))
        .select("rec_key", F.concat_ws("\x1f", "_s").alias("signature"))
    )


def deviation(now: np.ndarray, goal: np.ndarray) -> float:
    return float((((now - goal) ** 2) / np.maximum(goal, 1)).sum())


def best_exchange(got: np.ndarray, have: np.ndarray, part: np.ndarray, goal: np.ndarray, floor: np.ndarray, step: int) -> tuple[float, int, int]:
    """(gain, from, to) of the exchange of `step` records that lowers the deviation most; floors stay met."""
    now, weight = part.T @ got, 1 / np.maximum(goal, 1)
    giving, taking = np.flatnonzero(got >= step), np.flatnonzero(have - got >= step)
    best = (1e-9, -1, -1)
    slope, size = part @ (weight * 2 * (now - goal)), part @ weight
    for i in range(0, len(giving), BLOCK):
        a = giving[i : i + BLOCK]
        for j in range(0, len(taking), BLOCK):
            b = taking[j : j + BLOCK]
            common = (part[a] * weight) @ part[b].T
            gain = step * (slope[a][:, None] - slope[b][None, :]) - step * step * (size[a][:, None] + size[b][None, :] - 2 * common)
            low = (now - step < np.minimum(floor, now)).astype(float)  # categories that must not give without taking
            gain = np.where((part[a] * low) @ (1 - part[b]).T > 0, -1.0, gain)
            k = int(gain.argmax()) if gain.size else 0
            if gain.size and gain.flat[k] > best[0]:
                best = (float(gain.flat[k]), int(a[k // len(b)]), int(b[k % len(b)]))
    return best


def repair(have: dict[str, int], wanted: dict[str, int], floors: dict[str, int], size: int, seed: int) -> dict[str, int]:
    """Counts by signature of the repaired sample. have: available counts; wanted, floors: goals and least rows by category."""
    names, order = sorted(wanted), sorted(have)
    if not order:
        return {}
    column = {c: k for k, c in enumerate(names)}
    part = np.zeros((len(order), len(names)))
    for i, s in enumerate(order):
        for c in s.split("\x1f"):
            if c in column:
                part[i, column[c]] = 1
    full, goal, floor = (np.array(x, float) for x in ([have[s] for s in order], [wanted[c] for c in names], [floors[c] for c in names]))
    got, rnd = np.zeros(len(order)), random.Random(seed)
    for k in sorted(range(len(names)), key=lambda k: (part[:, k] @ full, names[k])):  # the rarest first
        owners = np.flatnonzero(part[:, k]).tolist()
        rnd.shuffle(owners)
        for i in owners:
            got[i] += max(0.0, min(full[i] - got[i], floor[k] - part[:, k] @ got))
    turn = list(range(len(order)))
    rnd.shuffle(turn)
    for fill in ("random", "rest"):
        for i in turn:
            left = int(min(full[i] - got[i], max(0.0, size - got.sum())))
            got[i] += rnd.randint(0, left) if fill == "random" else left
    step = 1 << max(1, int(max(size, got.sum()))).bit_length()
    while step:
        gain, a, b = best_exchange(got, full, part, goal, floor, step)
        if a < 0:
            step >>= 1
        else:
            got[a] -= step
            got[b] += step
    return {s: int(n) for s, n in zip(order, got)}


def tally(counts: dict[str, int], category: str) -> int:
    return sum(n for s, n in counts.items() if category in s.split("\x1f"))


def quota_sample(df: DataFrame, key: str, category: str, targets: DataFrame, size: int | None = None, part: int = 10, salt: str = "quota-v1", seed: int = 46) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: rec_key, signature. report: a row for each target, see REPORT.

    targets: (category, target_share, min_rows), a reference list of at most 1,000 rows.
    size: rows of the sample, by default floor(distinct keys with a category / part). The
    goal of a category is the larger of min_rows and floor(target_share * size); attainable
    says whether the repair reaches it in a sample that has room for all goals (the sample
    itself may have to share out less room than the goals ask).
    """
    spark = df.sparkSession
    rows = targets.select("category", "target_share", "min_rows").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("targets: more than 1000 categories")
    names = sorted({r["category"] for r in rows if r["category"] is not None})
    sigs = stored(signatures(df, key, category, names), "signatures")
    have = {r["signature"]: r["n"] for r in sigs.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).collect()}
    if size is None:
        size = sum(have.values()) // part
    wanted, floors = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r in rows:
        if (c := r["category"]) is not None:
            floors[c] = max(floors[c], int(r["min_rows"] or 0))
            wanted[c] = max(wanted[c], floors[c], int((r["target_share"] or 0.0) * size))
    counts = repair(have, wanted, floors, size, seed)
    room = sum(wanted.values())
    roomy = counts if room <= size else repair(have, wanted, floors, min(room, sum(have.values())), seed)
    report = spark.createDataFrame([(c, tally(have, c), wanted[c], tally(counts, c), tally(roomy, c) >= wanted[c]) for c in names], REPORT)
    quotas = spark.createDataFrame([(s, n) for s, n in counts.items() if n], "signature string, take bigint")
    return lowest_by_hash(sigs, "rec_key", quotas, "signature", salt), report
