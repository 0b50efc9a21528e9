"""Running totals and neighbours over ordered groups of any size.

Rows are dealt over consecutive ranges of (group, order) with about equally many rows, their boundaries taken
from the rows themselves: a small group lies within one range, a large one (or a crowded day, or many
scores close together) spans several. Every range is scanned by itself; what a group brings
along from earlier ranges is one row per range and is added in place. There is one plan for every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.functions import col

from cartwright.session import settle

RANGE = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: the number of the row's range of (keys, order). To be computed once.

    As many ranges as a shuffle has partitions by default, whatever the size of the table.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id())


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as a shuffle has, before it is grouped or joined by them.

    Adaptive execution merges the partitions of its own shuffles up to 64 MB, compressed, and a task then holds all
    groups of that many rows at once; these it leaves alone. Nothing is combined before the shuffle either, which pays
    where groups are almost as many as rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    """Count, mean and sum of squared distances from the mean."""
    return F.struct(n.alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(m2, F.lit(0.0)).alias("m2"))


def _joined(a: Column, b: Column) -> Column:
    """The moments of two sets of values together."""
    n, off = a["n"] + b["n"], a["mean"] - b["mean"]
    mean = F.try_divide(a["mean"] * a["n"] + b["mean"] * b["n"], n)
    return _moments(n, mean, a["m2"] + b["m2"] + F.coalesce(off * off * F.try_divide(a["n"] * b["n"], n), F.lit(0.0)))


def _edges(local: DataFrame, group: Column, sums: list[str], spreads: list[str], carried: list[str], first: list[str]) -> DataFrame:
    """One row per range: what its first group brings along, and the row that follows its last one.

    Only the first group of a range can have begun before it, and then the range before ends with it. A
    group's last row in a range holds its totals there. Rows in between decide nothing and are left out before
    the rows are sorted by range.
    """
    place = F.struct(group, col("_row"))
    totals = [(col(f"_l_{c}") + col(f"_s_{c}")).alias(c) for c in sums]
    for c in spreads:
        own = _moments(col(f"_v_{c}").isNotNull().cast("long"), col(f"_v_{c}"), F.lit(0.0))
        totals.append(_joined(col(f"_m_{c}"), own).alias(c))
    last = F.struct(*[col(c) for c in carried], F.lit(True).alias("_")).alias("last")
    ends = local.where((col("_row") == 1) | col("_more").isNull()).groupBy(RANGE).agg(
        F.min(group).alias("head"), F.max(group).alias("tail"),
        F.max_by(F.struct(*totals, last), place).alias("t"),
        F.min_by(F.struct(*[col(c) for c in first], F.lit(True).alias("_")), place).alias("first"),
    ).coalesce(1)
    # From here on one row per range: as many as a shuffle has partitions.
    along, so_far = Window.orderBy(RANGE), Window.partitionBy("tail").orderBy(RANGE)
    known = [F.sum(f"t.{c}").over(so_far).alias(c) for c in sums]
    ends = ends.withColumns({f"_k_{c}": F.first(f"t.{c}.mean").over(so_far) for c in spreads})
    for c in spreads:
        # Sums about the mean of the group's first range: they stay small however large the values are.
        n, off = col(f"t.{c}.n"), col(f"t.{c}.mean") - col(f"_k_{c}")
        total, shift = F.sum(n).over(so_far), F.sum(n * off).over(so_far)
        squares = F.sum(col(f"t.{c}.m2") + n * off * off).over(so_far)
        mean = col(f"_k_{c}") + F.try_divide(shift, total)
        known.append(_moments(total, mean, squares - F.try_divide(shift * shift, total)).alias(c))
    summed = ends.select(RANGE, "head", "tail", "first", F.struct(*known, col("t.last").alias("last")).alias("so_far"))
    return summed.select(
        col(RANGE).alias("_r"), "head", "tail",
        F.when(F.lag("tail").over(along).eqNullSafe(col("head")), F.lag("so_far").over(along)).alias("before"),
        F.when(F.lead("head").over(along).eqNullSafe(col("tail")), F.lead("first").over(along)).alias("after"),
    )


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: Mapping[str, Column] | None = None,
    spreads: Mapping[str, Column] | None = None,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    keep: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add to every row, from the other rows of its group in ascending ``order``:

    * per name in ``sums`` the total over all earlier rows, 0 on the first;
    * per name in ``spreads`` a struct (n, mean, m2) of the earlier rows' values;
    * ``previous_<column>`` and ``next_<column>``, NULL at the ends of the group;
    * ``is_first``.

    NULL is a group like any other. ``order`` names columns of ``df`` that should tell the rows of a group apart. Of
    the input columns those in ``keep`` stay (all by default). The result has ``_range``; where ``df`` has it
    already, from an earlier scan in the same order, that dealing is used again.
    """
    sums, spreads = dict(sums or {}), dict(spreads or {})
    kept = [c for c in (keep or df.columns) if c != RANGE]
    needed = [*dict.fromkeys([*kept, *keys, *order, *previous, *following])]
    measured = df.select(
        *needed, *([RANGE] if RANGE in df.columns else []),
        *[F.coalesce(v, F.lit(0)).alias(f"_s_{n}") for n, v in sums.items()],
        *[v.cast("double").alias(f"_v_{n}") for n, v in spreads.items()],
    )
    rows = measured if RANGE in df.columns else in_ranges(measured, keys, order, ranges)
    here = Window.partitionBy(RANGE, *keys).orderBy(*order)
    past = here.rowsBetween(Window.unboundedPreceding, -1)

    def moments(value: Column) -> Column:
        n = F.count(value).over(past)
        return _moments(n, F.avg(value).over(past), F.var_pop(value).over(past) * n)

    # The rows are dealt and scanned within their ranges once; the ranges' ends are read from the result.
    local = settle(rows.withColumns({
        "_row": F.row_number().over(here),
        "_more": F.lead(F.lit(True)).over(here),
        **{f"_l_{n}": F.coalesce(F.sum(f"_s_{n}").over(past), F.lit(0)) for n in sums},
        **{f"_m_{n}": moments(col(f"_v_{n}")) for n in spreads},
        **{f"_p_{c}": F.lag(c).over(here) for c in previous},
        **{f"_n_{c}": F.lead(c).over(here) for c in following},
    }))
    group = F.struct(*keys)
    edges = _edges(local, group, list(sums), list(spreads), list(previous), list(following))
    # One row per range: as many as a shuffle has partitions.
    joined = local.join(F.broadcast(edges), col(RANGE) == col("_r"))
    before = F.when(group.eqNullSafe(col("head")), col("before"))
    after = F.when(group.eqNullSafe(col("tail")), col("after"))
    first, last = col("_row") == 1, col("_more").isNull()
    return joined.select(
        *kept, RANGE,
        *[(col(f"_l_{n}") + F.coalesce(before[n], F.lit(0))).alias(n) for n in sums],
        *[F.when(before.isNull(), col(f"_m_{n}")).otherwise(_joined(col(f"_m_{n}"), before[n])).alias(n) for n in spreads],
        *[F.when(first, before["last"][c]).otherwise(col(f"_p_{c}")).alias(f"previous_{c}") for c in previous],
        *[F.when(last, after[c]).otherwise(col(f"_n_{c}")).alias(f"next_{c}") for c in following],
        (first & before.isNull()).alias("is_first"),
    )


def trailing_count(
    df: DataFrame, keys: list[str], position: str, weight: str, reach: int, width: int = 4096
) -> DataFrame:
    """Add ``trailing``: the weight found in ``[position - reach, position - 1]`` of the same group.

    Input has one row per (group, position). A stretch covers ``width`` units of position, so it holds no more
    rows than it has positions, and also receives copies of the rows within ``reach`` before it: no
    frame leaves a stretch.
    """
    stretch = F.floor(F.col(position) / width)
    last = F.floor((F.col(position) + reach) / width)
    copies = df.withColumn("_stretch", F.explode(F.sequence(stretch, last)))
    near = Window.partitionBy(*keys, "_stretch").orderBy(position).rangeBetween(-reach, -1)
    return (
        copies.withColumn("trailing", F.coalesce(F.sum(weight).over(near), F.lit(0)))
        .where(F.col("_stretch") == stretch)
        .drop("_stretch")
    )
