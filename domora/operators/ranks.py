"""Places in a total order and exact quantiles over all rows, without one task that orders a whole table or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domora.operators.joins import looked_up_side
from domora.session import materialise


def with_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place from 1 on, in the order of the given columns.

    Spark deals the rows out by ranges of the order, so that a partition holds neighbours; a row's place is its place
    in the partition and the rows of the partitions before. Rows that the order does not tell apart get places in any
    order, and all of them are in one partition: end the order with a key. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed)  # the number of a row is its partition's number and its place there
    counts = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    before, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # likewise
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


#: Rows of a range that a last pass orders by value, and cells that a pass cuts a range into.
SMALL_RANGE, CELLS = 1 << 16, 1 << 12


def _on(left: str, right: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, list[float]]], between: bool = True) -> DataFrame:
    """keys and, by name, the exact quantiles of a value in each group, as an array in the order asked.

    Selection by histograms: the range of a group's values is cut into cells of equal width, the cells are counted,
    and the cell that holds a rank becomes the range of the next pass, until it has SMALL_RANGE rows or one value;
    only then are values ordered. What tasks hold are counts, however large or equal the values of a group.
    between: a quantile between two ranks is interpolated; else it is the value of rank ceil(share x n). Nulls, NaN
    and infinities are left out; a group without a value has no row. Null keys are a group.
    """
    items = list(wanted.values())
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_item"), c.cast("double").alias("_v")) for i, (c, _) in enumerate(items)]))
    finite = F.col("_x._v").isNotNull() & ~F.isnan("_x._v") & (F.abs("_x._v") != float("inf"))
    long = materialise(rows.select(*keys, each.alias("_x")).where(finite).select(*keys, "_x._item", "_x._v"))
    group = [*keys, "_item"]

    def ranks(i: int) -> Column:
        """The ranks, from 0 on, of an item's quantiles and how much the later of two counts."""
        out = []
        for k, p in enumerate(items[i][1]):
            at = F.lit(float(p)) * (F.col("_n") - 1) if between else F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")) - 1, F.lit(0)).cast("double")
            low = F.floor(at)
            out += [F.struct(F.lit(k).alias("_k"), F.lit(s).alias("_side"), F.least(low + s, F.col("_n") - 1).alias("_r"), (at - low).alias("_part")) for s in ((0, 1) if between else (0,))]
        return F.array(*out)

    every = None
    for i in range(len(items)):
        every = F.when(F.col("_item") == i, ranks(i)) if every is None else every.when(F.col("_item") == i, ranks(i))
    whole = long.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = materialise(whole.withColumn("_t", F.explode(every)).select(*group, "_t._k", "_t._side", "_t._r", "_t._part", "_lo", "_hi", F.col("_n").alias("_inside")))

    def met(rows_of: DataFrame) -> DataFrame:
        """The values in the ranges, with the range's low end as `lo`."""
        spans = looked_up_side(rows_of.select(*group, "_lo", "_hi").distinct())
        return long.alias("a").join(spans.alias("b"), _on("a", "b", group) & F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))).select(*[F.col(f"a.{c}").alias(c) for c in group], "_lo", "_hi", "_v")

    def narrowed(found: DataFrame, targets: DataFrame, by: str) -> DataFrame:
        """targets in the cell of found that holds their rank. found: group, lo, by, c, first, last."""
        before = F.sum("_c").over(Window.partitionBy(*group, "_lo").orderBy(by)) - F.col("_c")
        cells = found.withColumn("_before", before).alias("b")
        on = _on("a", "b", [*group, "_lo"]) & (F.col("a._r") >= F.col("b._before")) & (F.col("a._r") < F.col("b._before") + F.col("b._c"))
        return targets.alias("a").join(cells, on).select(*[F.col(f"a.{c}").alias(c) for c in (*group, "_k", "_side", "_part")], (F.col("a._r") - F.col("b._before")).alias("_r"), F.col("b._first").alias("_lo"), F.col("b._last").alias("_hi"), F.col("b._c").alias("_inside"))

    done = state.where("_lo = _hi")
    open_ = state.where("_lo < _hi")
    while open_.where(F.col("_inside") > SMALL_RANGE).limit(1).count():
        big = open_.where(F.col("_inside") > SMALL_RANGE)
        width = F.col("_hi") / 2 - F.col("_lo") / 2
        cell = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * CELLS), F.lit(CELLS - 1))
        found = met(big).groupBy(*group, "_lo", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        next_ = materialise(narrowed(found, big, "_cell").unionByName(open_.where(F.col("_inside") <= SMALL_RANGE).select(*group, "_k", "_side", "_part", "_r", "_lo", "_hi", "_inside")))
        done = done.unionByName(next_.where("_lo = _hi"), allowMissingColumns=True)
        open_ = next_.where("_lo < _hi")
    last = met(open_).groupBy(*group, "_lo", "_v").agg(F.count("*").alias("_c")).withColumns({"_first": F.col("_v"), "_last": F.col("_v")})
    picked = done.select(*group, "_k", "_side", "_part", "_lo").unionByName(narrowed(last, open_, "_v").select(*group, "_k", "_side", "_part", "_lo"))
    one = picked.groupBy(*group, "_k").agg(F.max(F.when(F.col("_side") == 0, F.col("_lo"))).alias("_x"), F.max(F.when(F.col("_side") == 1, F.col("_lo"))).alias("_y"), F.max("_part").alias("_part"))
    value = (F.col("_x") * (1 - F.col("_part")) + F.col("_y") * F.col("_part")) if between else F.col("_x")
    arrays = one.withColumn("_value", F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(value) if between else value).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_value"))), lambda s: s["_value"]).alias("_every"))
    return arrays.groupBy(*keys).agg(*[F.max(F.when(F.col("_item") == i, F.col("_every"))).alias(name) for i, name in enumerate(wanted)])


def medians(rows: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """keys and the exact median of each value, by name."""
    found = quantiles(rows, keys, {n: (c, [0.5]) for n, c in wanted.items()})
    return found.select(*keys, *[F.col(n)[0].alias(n) for n in wanted])


def beside(aggregates: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """aggregates of groups with the columns of found, nulls where a group has none; both have one row for each group."""
    new = [c for c in found.columns if c not in keys]
    return aggregates.alias("a").join(found.alias("b"), _on("a", "b", keys), "left").select("a.*", *[F.col(f"b.{c}").alias(c) for c in new])
