"""Filling containers of fixed capacity with texts measured in tokens.

Method: space-filling-curve order. Each text is a vector, hashed from its tokens and
projected to few dimensions; its Hilbert key gives its place along the curve, so that
neighbours are alike. The curve is cut into stretches of about `STRETCH` texts by ranges of
the whole key, and each stretch is packed by best fit, longest first within a block of neighbours, with a bounded
number of open containers carried along the curve.

A text is split only if it exceeds the capacity: into full containers and a rest that is
packed like any other item. Stretches come from two histograms: one of the 65,536 prefixes of
16 bits, and within the prefixes of many texts one of the other 16 bits. Only texts of one and
the same key (copies, above all), if they are more than a stretch, are cut by the hash of
their own keys, so no task grows with a hot group. All is a function of the data: reruns and other
partitionings give the same containers.

Defined cases: null and empty texts are items of size 0 and take no space; capacities must be
positive, others are left out; repeated keys are separate items only if their rows differ.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaloom.llm.bpe import default_path, encoder
from actaloom.session import spread, stored

DIMS, BITS = 4, 8
#: Texts of one stretch of the curve, of one block of neighbours, and open containers.
STRETCH, NEAR, OPEN = 16_384, 2_048, 256
#: Cuts of the curve up to which they are broadcast (4 bytes each), beyond that they are joined by a shuffle.
CUTS = 4_000_000


def hilbert(x: np.ndarray) -> np.ndarray:
    """Hilbert keys of points (rows of DIMS integers under 2^BITS), by Skilling's transform."""
    x = x.astype(np.int64).T.copy()
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(DIMS):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[DIMS - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            key = key << 1 | (x[i] >> b & 1)
    return key


def projection(size: int) -> np.ndarray:
    """A fixed direction of +1 and -1 for every token."""
    h = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.stack([(h >> np.uint64(3 * k) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(DIMS)], 1)


def place(df: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """(key, n_tokens, curve): size and Hilbert key of each text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or default_path())  # found by the worker itself
        table = projection(len(enc.text))
        for b in batches:
            ids = [np.frombuffer(enc.ids_of(t), "<i4") for t in b.column(1).to_pylist()]
            n = np.array([len(i) for i in ids], np.int64)
            mean = np.stack([table[i].sum(0) / max(1.0, len(i) ** 0.5) for i in ids]) if ids else np.zeros((0, DIMS))
            grid = np.clip((1 / (1 + np.exp(-mean / 4)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(hilbert(grid))], names=["key", "n_tokens", "curve"])

    return spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"key {kind}, n_tokens bigint, curve bigint")


class Packer:
    """Best fit into the open containers of one capacity."""

    def __init__(self, capacity: int, label: str) -> None:
        self.capacity, self.label, self.made = capacity, label, 0
        self.open: list[tuple[int, int]] = []  # (free tokens, container)

    def fresh(self) -> int:
        self.made += 1
        return self.made - 1

    def block(self, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(item, piece, start, tokens, container; position follows from the order) of a block of neighbours."""
        out, rest = [], []
        for item, n in enumerate(sizes):
            whole = n // self.capacity if n > self.capacity else 0
            for piece in range(whole):
                out.append((item, piece, piece * self.capacity, self.capacity, self.fresh(), 0))
            if n - whole * self.capacity or not n:
                rest.append((n - whole * self.capacity, item, whole))
        for n, item, piece in sorted(rest, key=lambda r: (-r[0], r[1])):
            at = bisect_left(self.open, (n, -1))
            free, c = self.open.pop(at) if at < len(self.open) else (self.capacity, self.fresh())
            out.append((item, piece, piece * self.capacity, n, c, self.capacity - free))
            if free - n:
                insort(self.open, (free - n, c))
            elif not n:
                insort(self.open, (free, c))
        del self.open[: max(0, len(self.open) - OPEN)]  # the fullest are closed
        return out


def with_stretch(items: DataFrame) -> DataFrame:
    """items (key, n_tokens, curve) with the name of their stretch of the curve.

    A prefix of at most STRETCH texts lies in one stretch with its neighbours. A larger one is
    cut between keys; `cuts` are the keys at which a new stretch begins (at most one for each
    STRETCH texts and two for each crowded key), `crowded` the keys of more than STRETCH texts.
    """
    half = DIMS * BITS - 16
    rows = items.withColumn("prefix", F.shiftright("curve", half).cast("int")).withColumn("rest", F.col("curve").bitwiseAND(F.lit((1 << half) - 1)).cast("int"))
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    hist = stored(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")), "prefixes")
    plan = hist.withColumn("stretch", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / STRETCH)).select("prefix", "stretch", "n")
    large = F.broadcast(hist.filter(F.col("n") > STRETCH).select("prefix"))  # at most 65,536 rows, like plan
    keys = rows.join(large, "prefix").groupBy("prefix", "rest").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("prefix").orderBy("rest")  # at most 65,536 rows
    before = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = keys.withColumn("at", F.floor(before / STRETCH)).withColumn("crowd", F.col("n") > STRETCH)
    new = (F.col("at") > F.lag("at", 1, -1).over(within)) | F.col("crowd") | F.lag("crowd", 1, False).over(within)
    cuts = keys.withColumn("new", new).filter("new").groupBy("prefix").agg(
        F.sort_array(F.collect_list("rest")).alias("cuts"),
        F.map_from_entries(F.collect_list(F.when(F.col("crowd"), F.struct("rest", F.ceil(F.col("n") / STRETCH).cast("int"))))).alias("crowded"),
    )
    plan = stored(plan.join(cuts, "prefix", "left").select("prefix", "stretch", "cuts", "crowded"), "stretches")
    if plan.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0] <= CUTS:
        plan = F.broadcast(plan)
    placed = rows.join(plan, "prefix")
    own = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("rest"))), F.lit(0))
    parts = F.try_element_at("crowded", F.col("rest"))
    part = F.when(parts.isNotNull(), F.pmod(F.xxhash64("key"), parts)).otherwise(F.lit(0))
    whole = F.col("cuts").isNull()
    return placed.withColumn("name", F.concat_ws("-", "stretch", F.when(whole, F.lit("")).otherwise(F.col("prefix").cast("string")), F.when(whole, F.lit(0)).otherwise(own), part))


def pack(df: DataFrame, key: str, text: str, sizes: DataFrame, path: str | None = None) -> DataFrame:
    """(pack_id, container_id, position, key, piece_no, start_token, n_tokens): where every text, or piece of a text, lies.

    sizes: (pack_id, capacity), a reference list of at most 1,000 rows.
    """
    kind = df.schema[key].dataType.simpleString()
    caps = [(r["pack_id"], r["capacity"]) for r in sizes.select("pack_id", "capacity").distinct().orderBy("pack_id").limit(1001).collect() if r["capacity"] and r["capacity"] > 0]
    if len(caps) > 1000:
        raise ValueError("sizes: more than 1000 capacities")
    items = stored(place(df, key, text, path), "places")
    ordered = with_stretch(items).select("name", "key", "n_tokens", "curve").repartition("name").sortWithinPartitions("name", "curve", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packers = None, []

        def flush(name: str, keys: pa.Array, sizes_: list[int]) -> pa.RecordBatch:
            nonlocal current, packers
            if name != current:
                current, packers = name, [Packer(c, f"{i}/{name}") for i, c in caps]
            cols: list[list] = [[], [], [], [], [], [], []]
            for (pack_id, _), p in zip(caps, packers):
                rows = p.block(sizes_)
                cols[0] += [pack_id] * len(rows)
                cols[1] += [f"{p.label}/{r[4]}" for r in rows]
                for k, c in ((2, 5), (3, 0), (4, 1), (5, 2), (6, 3)):
                    cols[k] += [r[c] for r in rows]
            types = (pa.int64(), pa.string(), pa.int64(), None, pa.int64(), pa.int64(), pa.int64())
            arrays = [keys.take(pa.array(c, pa.int64())) if t is None else pa.array(c, t) for c, t in zip(cols, types)]
            return pa.RecordBatch.from_arrays(arrays, names=["pack_id", "container_id", "position", "key", "piece_no", "start_token", "n_tokens"])

        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]) if len(names) else []
            for i, j in zip(edges[:-1], edges[1:]):
                for k in range(i, j, NEAR):
                    part = b.slice(k, min(NEAR, j - k))
                    yield flush(names[i], part.column(1), part.column(2).to_pylist())

    schema = f"pack_id bigint, container_id string, position bigint, key {kind}, piece_no bigint, start_token bigint, n_tokens bigint"
    return ordered.mapInArrow(run, schema).withColumnRenamed("key", key)


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, fill): the share of all space that is used, for each capacity."""
    each = packed.filter("n_tokens > 0").groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
    return total.join(F.broadcast(sizes.select("pack_id", "capacity").distinct().limit(1000)), "pack_id").select("pack_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
