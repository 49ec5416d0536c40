"""Positions in a global order without a task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slabwise.session import cut, shuffle_width


def numbered(rows: DataFrame, keys: list[str], name: str, first: int = 0) -> DataFrame:
    """rows with `name`: their place in the order of keys, from `first`.

    Rows are dealt into ranges of the keys, which are kept, so that a range that is read
    again is the same; the sizes of the ranges before are added to the place within one.
    """
    dealt = cut(rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).withColumn("__r", F.spark_partition_id()))
    sizes = dealt.groupBy("__r").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("__r", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__r").orderBy(*keys)) + F.lit(first - 1)
    return dealt.join(F.broadcast(starts), "__r").withColumn(name, place.cast("long")).drop("__r", "__start")


#: Rows of a group's bracket from which it is narrowed once more.
LAST = 50_000
#: A bracket takes in this share of its group's places on either side, which a sketch of that accuracy can tell apart.
MARGIN = 0.003
_STEPS = [i / 1000 for i in range(1001)]


def _sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """The values at a thousandth of the places each, roughly; partial sketches are merged, so no task sees a group."""
    return values.groupBy(*keys).agg(F.percentile_approx("__v", _STEPS, 10_000).alias("steps"))


class _Bracket:
    """Where one quantile of one group must lie: values lo to hi around the places first and second; below, inside: how many values lie there."""

    def __init__(self, key: tuple, share: float, n: int, least: float, most: float):
        at = (n - 1) * share
        self.key, self.share, self.first, self.second, self.part = key, share, math.floor(at), math.ceil(at), at - math.floor(at)
        self.least = self.lo = least
        self.most = self.hi = most
        self.below, self.inside, self.open = 0, n, True

    def narrow(self, steps: list[float]) -> None:
        """New borders from a sketch of the values inside."""
        low, high = ((p - self.below) / self.inside + m for p, m in ((self.first, -MARGIN), (self.second, MARGIN)))
        self.before, self.bounds = self.inside, (self.lo, self.hi)
        self.lo = steps[math.floor(low * 1000)] if low > 0 else self.lo
        self.hi = steps[math.ceil(high * 1000)] if high < 1 else self.hi

    def counted(self, below: int, inside: int) -> None:
        """Counts decide: borders that miss a place go back to where they were; what hardly shrinks is left as it is."""
        if below > self.first or below + inside <= self.second:
            self.lo, self.hi, self.open = *self.bounds, False
            return
        self.below, self.inside = below, inside
        self.open = inside > LAST and self.lo < self.hi and inside < 0.9 * self.before


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], written: bool = False) -> DataFrame:
    """Exact quantiles of a column by group, interpolated between neighbours: (by, share, quantile). Nulls don't count, NaN is the greatest.

    No exchange of all values and no sort of them: a sketch brackets each wanted place, one
    pass counts the values below and within, and a bracket of more than LAST rows is
    narrowed again. Then the brackets' different values alone are shuffled, with their counts, so
    ties cost nothing. The sketch only places borders; counts decide, so its error can't reach
    the result. The column is written once, where its rows stand, unless `written` says that rows are
    cheap to read again. Groups are slices and the like: few.
    """
    spark, names = rows.sparkSession, by
    by = [f"__g{i}" for i in range(len(names))]
    values = rows.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(names, by)), F.col(value).cast("double").alias("__v"))
    values = values if written else cut(values)
    known = values.filter(~F.isnan("__v"))
    n = F.count(F.when(~F.isnan("__v"), 1))
    real = F.when(~F.isnan("__v"), F.col("__v"))
    groups = values.groupBy(*by).agg(F.count("*").alias("n"), n.alias("known"), F.min(real).alias("least"), F.max(real).alias("most")).collect()  # a row for each group
    brackets, lost = [], []
    for r in groups:
        for s in sorted({float(s) for s in shares}):
            b = _Bracket(tuple(r[c] for c in by), s, r["n"], r["least"], r["most"])
            b.inside = r["known"]
            # places among the NaN
            (lost if b.second >= r["known"] else brackets).append(b)
            b.open = b.inside > LAST and b.lo != b.hi
    fields = StructType([values.schema[c] for c in by])
    alike = lambda t: [F.col(f"values.{c}").eqNullSafe(F.col(f"b.{c}")) for c in t]

    def met(some: list[_Bracket]) -> DataFrame:
        schema = StructType([*fields, *StructType.fromDDL("share double, lo double, hi double")])
        table = spark.createDataFrame([(*b.key, b.share, b.lo, b.hi) for b in some], schema)
        both = known.alias("values").join(F.broadcast(table.alias("b")), alike(by), "inner")  # a row for each group and share
        return both.select(*(F.col(f"b.{c}").alias(c) for c in by), "share", "lo", "hi", "__v")

    inside, keys = F.col("__v").between(F.col("lo"), F.col("hi")), [*by, "share"]
    of = lambda r: (tuple(r[c] for c in by), r["share"])
    first = True
    while todo := [b for b in brackets if b.open]:
        # at first every bracket is its whole group, which one sketch serves
        found = _sketch(known, by) if first else _sketch(met(todo).filter(inside), keys)
        steps = {tuple(r[c] for c in by) if first else of(r): r["steps"] for r in found.collect()}
        for b in todo:
            b.narrow(steps[b.key if first else (b.key, b.share)])
        counts = met(todo).groupBy(*keys).agg(F.count(F.when(F.col("__v") < F.col("lo"), 1)).alias("below"), F.count(F.when(inside, 1)).alias("inside"))
        got = {of(r): (r["below"], r["inside"]) for r in counts.collect()}
        for b in todo:
            b.counted(*got[b.key, b.share])
        first = False
    schema = StructType([*fields, *StructType.fromDDL("share double, below long, first long, second long, part double")])
    asked = spark.createDataFrame([(*b.key, b.share, b.below, b.first, b.second, b.part) for b in brackets], schema)
    counts = met(brackets).filter(inside).groupBy(*keys, "__v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("__v"))
    placed = counts.withColumn("upto", upto).alias("values").join(F.broadcast(asked.alias("b")), alike(keys))
    holds = lambda p: F.max(F.when(F.col(p).between(F.col("below") + F.col("upto") - F.col("c"), F.col("below") + F.col("upto") - 1), F.col("__v")))
    ends = placed.groupBy(*(F.col(f"b.{c}").alias(c) for c in keys), "part").agg(holds("first").alias("u"), holds("second").alias("v"))
    named = [F.col(g).alias(c) for g, c in zip(by, names)]
    out = ends.select(*named, "share", F.when(F.col("part") == 0, F.col("u")).otherwise((1 - F.col("part")) * F.col("u") + F.col("part") * F.col("v")).alias("quantile"))
    if not lost:
        return out
    schema = StructType([*fields, *StructType.fromDDL("share double, quantile double")])
    return out.unionByName(spark.createDataFrame([(*b.key, b.share, float("nan")) for b in lost], schema).select(*named, "share", "quantile"))


#: Steps into which a pass cuts the values that may be a group's median, and values of a group that are then shuffled.
_CUTS, _FEW = 4096, 1_000_000


def medians_of_made(rows: DataFrame, by: str, value: str, most: float) -> DataFrame:
    """Exact medians by group of values in [0, most], of rows that are made anew at each pass: (by, quantile). Neither NaN nor null.

    Nothing of the rows' number is written or shuffled: a pass counts them by steps between two values, and the
    step that holds the median is cut again while it holds more than _FEW. Groups are slices and the like: few.
    """
    values = rows.select(F.col(by).alias("__g"), F.col(value).alias("__v"))
    kind, spark = values.schema["__g"].dataType.simpleString(), rows.sparkSession
    schema = f"__g {kind}, lo double, hi double, below long, first long, second long"
    asked = values.withColumns({"lo": F.lit(0.0), "hi": F.lit(float(most)), "below": F.lit(0).cast("long"), "first": F.lit(None).cast("long"), "second": F.lit(None).cast("long")})
    done, few, group = [], [], ["__g", "below", "first", "second"]
    while True:
        step = F.least(F.lit(_CUTS - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(_CUTS)))
        counts = asked.groupBy(*group, step.alias("step")).agg(F.count("*").alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        own = Window.partitionBy("__g")
        n, upto = F.sum("c").over(own), F.col("below") + F.sum("c").over(own.orderBy("step"))
        placed = counts.withColumns({"first": F.coalesce("first", F.floor((n - 1) / 2)), "second": F.coalesce("second", F.floor(n / 2)), "upto": upto})
        holds = lambda p: F.col(p).between(F.col("upto") - F.col("c"), F.col("upto") - 1)
        found: dict = {}
        for r in placed.filter(holds("first") | holds("second")).orderBy("step").collect():  # one or two rows for each group
            found.setdefault(r["__g"], []).append(r)
        again = []
        for g, r in found.items():
            row = (g, r[0]["lo"], r[0]["hi"], r[0]["upto"] - r[0]["c"], r[0]["first"], r[0]["second"])
            if len(r) == 2 or r[0]["lo"] == r[0]["hi"]:
                # of two steps the one ends with the first place and the other begins with the second
                done.append((g, r[0]["hi"], r[-1]["lo"]))
            else:
                (few if r[0]["c"] <= _FEW else again).append(row)
        if not again:
            break
        asked = values.join(F.broadcast(spark.createDataFrame(again, schema)), "__g").filter(F.col("__v").between(F.col("lo"), F.col("hi")))
    inside = values.join(F.broadcast(spark.createDataFrame(few, schema)), "__g").filter(F.col("__v").between(F.col("lo"), F.col("hi")))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("__g").orderBy("__v"))
    placed = inside.groupBy(*group, "__v").agg(F.count("*").alias("c")).withColumn("upto", upto)
    at = lambda p: F.max(F.when(F.col(p).between(F.col("upto") - F.col("c"), F.col("upto") - 1), F.col("__v")))
    ends = placed.groupBy("__g").agg(at("first").alias("u"), at("second").alias("v")).unionByName(spark.createDataFrame(done, f"__g {kind}, u double, v double"))
    return ends.select(F.col("__g").alias(by), F.when(F.col("u") == F.col("v"), F.col("u")).otherwise(0.5 * F.col("u") + 0.5 * F.col("v")).alias("quantile"))
