"""Sharding along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitguard.llm.ranks import ranked
from splitguard.storage import materialize

BITS = 5


def octave_steps(size: Column, per_octave: int = 1, bits: int = BITS) -> Column:
    """A size on a logarithmic scale, in ``per_octave`` steps per doubling, cut at 2**bits - 1: with the defaults that is 2 GB. NULL is 0."""
    step = F.floor(F.log2(F.greatest(size.cast("double"), F.lit(1.0))) * per_octave)
    return F.coalesce(F.least(step, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def name_steps(name: Column, bits: int = BITS) -> Column:
    """A name as one of 2**bits steps without order, so that equal names lie together and nothing need be known of the others. NULL is 0."""
    return F.coalesce(F.pmod(F.crc32(name.cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("long")


def step_cuts(rows: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list]:
    """Per column at most 2**bits - 1 values that cut its range into steps, ascending.

    Numbers are cut at the quantiles of the rows, from a sketch of bounded size; no exact cut is needed, since the
    steps decide only which rows lie near each other. Other columns are cut by the rank of their distinct values,
    so a value that holds a third of all rows takes one step and moves no other. Only the cuts reach the driver.
    """
    steps, cuts = 1 << bits, {}
    numeric = [c for c, t in rows.dtypes if c in columns and t in ("bigint", "int", "double")]
    if numeric:
        shares = [k / steps for k in range(1, steps)]
        found = rows.agg(*[F.percentile_approx(c, shares).alias(c) for c in numeric], *[F.min(c).alias(f"_least_{c}") for c in numeric]).first()
        cuts.update({c: sorted({cut for cut in found[c] or [] if cut > found[f"_least_{c}"]}) for c in numeric})
    for c in columns:
        if c not in cuts:
            cuts[c] = sorted(r["name"] for r in _first_names(rows.select(F.col(c).alias("name")), steps).collect())
    return cuts


def _first_names(rows: DataFrame, steps: int) -> DataFrame:
    """The first name of every step but the lowest, at most ``steps`` - 1 rows, where the steps hold equally many distinct names."""
    distinct = rows.filter("name IS NOT NULL").distinct().repartitionByRange("name").withColumn("part", F.spark_partition_id())
    placed = materialize(distinct, "names")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row per range of names.
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    place = F.col("start") + F.col("within")
    numbered = placed.withColumn("within", within).join(F.broadcast(starts), "part")
    return numbered.groupBy(F.floor(place * steps / F.col("total")).alias("step")).agg(F.min("name").alias("name")).filter("step > 0")


def steps_by(column: Column, cuts: list, bits: int = BITS) -> Column:
    """The number of cuts that a value reaches, spread over all 2**bits steps so that few values use the high bits too. NULL is 0, with the smallest values."""
    if not cuts:
        return F.lit(0).cast("long")
    reached = F.size(F.filter(F.lit(cuts), lambda cut: cut <= column))
    return F.when(column.isNull(), F.lit(0)).otherwise(F.floor(reached * (1 << bits) / (len(cuts) + 1))).cast("long")


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Position on the curve of a cell with ``bits`` bits per coordinate.

    The axes-to-transpose rule of Skilling (2004): from the highest bit down, each coordinate either
    inverts the lower bits of the first or exchanges them with it; then a Gray code, then the bits are
    interleaved.
    """
    dims = len(coordinates)
    turns = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        inverts = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        new_first = F.when(inverts, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(inverts, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == i, new_own).otherwise(v))

    def gray(x: Column) -> Column:
        """Each value xor all before it."""
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))

    def level(x: Column) -> Column:
        bits_down = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
        last = F.element_at(x, -1)
        flip = F.aggregate(
            bits_down, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )
        return _once(flip, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def woven(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
        bit = lambda s: F.call_function("shiftright", F.get(x, s["i"]), s["b"]).bitwiseAND(F.lit(1).cast("long"))
        return F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + bit(s))

    start = F.array(*[c.cast("long") for c in coordinates])
    turned = F.aggregate(turns, start, turn)
    return _once(turned, lambda x: _once(gray(x), lambda y: _once(level(y), woven)))


def _once(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once per row (bound to a lambda variable)."""
    return F.element_at(F.transform(F.array(value), build), 1)


def curve_runs(rows: DataFrame, coordinates: list[Column], order: list[str], n_shards: int, bits: int = BITS) -> DataFrame:
    """Per row: row (a struct of all its columns), curve_index, shard, slot.

    Runs of the curve order are cut into shards whose row counts differ by one at most. Rows of one curve
    cell are ordered by a hash and then by ``order``; rows alike in it come in any order. ``slot`` counts
    from 0 within the shard. An empty table gives no rows.
    """
    keys = [f"key_{i}" for i in range(len(order))]
    held = rows.select(F.struct(*rows.columns).alias("row"), hilbert_index(coordinates, bits).alias("curve_index"), *[F.col(o).alias(k) for o, k in zip(order, keys)])
    stored = materialize(held, "curve")
    total = stored.agg(F.count("*")).scalar()
    placed = ranked(stored, "curve_index", keys).withColumn("total", total)
    cut = placed.withColumn("shard", F.expr(f"(place * {n_shards}) div total").cast("int"))
    start = F.expr(f"(cast(shard as bigint) * total + {n_shards - 1}) div {n_shards}")
    return cut.select("row", "curve_index", "shard", (F.col("place") - start).alias("slot"))


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard: its rows and the smallest and largest value of each column, for skipping whole shards."""
    aggs = [f(f"row.{c}").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *aggs)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each sorted along the curve, so the row groups of its files can be skipped too."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
