"""Boreholes: collars (hole_id, x, y, z, eoh), intervals (hole_id, frm, to, code), samples (hole_id, frm, to, values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.joins import dealt


def collars(rows: DataFrame, order: str) -> DataFrame:
    """Rows with an id and a place; the first by ``order`` of each id. A depth that isn't positive is null."""
    known = rows.where("hole_id is not null and x is not null and y is not null and z is not null")
    first = known.groupBy("hole_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "hole_id"]), order).alias("r")).select("hole_id", "r.*")
    return first.withColumn("eoh", F.when(F.col("eoh") > 0, F.col("eoh")))


def intervals(rows: DataFrame) -> DataFrame:
    """Intervals with their ends in order; those without a hole, an end or a length are dropped, an empty code stays."""
    known = rows.where("hole_id is not null and frm is not null and to is not null and frm <> to")
    return known.withColumn("a", F.least("frm", "to")).withColumn("b", F.greatest("frm", "to")).drop("frm", "to").withColumnsRenamed({"a": "frm", "b": "to"})


def check(holes: DataFrame, rows: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Intervals with ``orphan``, ``beyond`` (the hole's end), ``gap`` and ``overlap`` against the deepest end above them in the hole."""
    above = F.max("to").over(Window.partitionBy("hole_id").orderBy("frm", "to").rowsBetween(Window.unboundedPreceding, -1))
    known = rows.withColumn("above", above).join(holes.select("hole_id", "eoh", F.lit(True).alias("found")), "hole_id", "left")
    return known.select(
        *rows.columns,
        F.col("found").isNull().alias("orphan"),
        F.coalesce(F.col("to") > F.col("eoh") + eps, F.lit(False)).alias("beyond"),
        F.coalesce(F.col("frm") > F.col("above") + eps, F.lit(False)).alias("gap"),
        F.coalesce(F.col("frm") < F.col("above") - eps, F.lit(False)).alias("overlap"),
    )


def composite(samples: DataFrame, targets: DataFrame, values: list[str]) -> DataFrame:
    """Length-weighted means of ``values`` over target intervals (hole_id, t_frm, t_to, ...), each over the samples that have it.

    ``cover`` is the share of the target that samples cover, overlaps once; ``overlap`` tells whether
    samples overlap there, ``<value>_cover`` the length-weighted share with that value. Intervals that
    only touch don't overlap. Targets without samples stay, with cover 0.

    Targets are dealt by hole once, and samples unless they are already; the overlap join, the running end of the samples above, the sums and
    the targets' other columns, which travel along, all keep to that. One task sorts for each of them, so tasks grow in number with the samples, not in size.
    """
    n = dealt(samples)
    keys = ["hole_id", "t_frm", "t_to"]
    others = [c for c in targets.columns if c not in keys]
    rest = F.collect_list(F.struct(*others) if others else F.lit(1)).alias("rest")
    wanted = targets.repartition(n, "hole_id").groupBy(*keys).agg(rest).alias("t")
    s = samples.repartition(n, "hole_id").select(F.col("hole_id").alias("s_hole"), "frm", "to", *values).alias("s")
    met = wanted.join(s, (F.col("t.hole_id") == F.col("s.s_hole")) & (F.col("s.frm") < F.col("t.t_to")) & (F.col("s.to") > F.col("t.t_frm")), "left").drop("s_hole")
    met = met.withColumn("a", F.when(F.col("frm").isNotNull(), F.greatest("frm", "t_frm"))).withColumn("b", F.when(F.col("frm").isNotNull(), F.least("to", "t_to"))).withColumn("len", F.col("b") - F.col("a"))
    reach = F.max("b").over(Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("added", F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), F.coalesce(reach, F.col("a")))))
    length, aggs = F.col("t_to") - F.col("t_frm"), []
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.col("len"))
        aggs += [F.try_divide(F.sum(F.col(v) * F.col("len")), F.sum(known)).alias(v), F.coalesce(F.sum(known), F.lit(0.0)).alias(f"{v}_cover")]
    got = met.groupBy(*keys).agg(F.first("rest").alias("rest"), *aggs, F.coalesce(F.sum("added"), F.lit(0.0)).alias("cover"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("len"))
    got = got.withColumn("overlap", F.col("len") > F.col("cover") + 1e-9).withColumns({c: F.col(c) / length for c in ["cover", *[f"{v}_cover" for v in values]]})
    return got.select(*keys, F.explode("rest").alias("r"), *[c for v in values for c in (v, f"{v}_cover")], "cover", "overlap").select(*keys, *([f"r.{c}" for c in others]), *[c for v in values for c in (v, f"{v}_cover")], "cover", "overlap")


def bed_grades(composites: DataFrame, values: list[str], code: str = "code") -> DataFrame:
    """Per hole and bed: means of composites weighted by length times their cover, and the bed's length."""
    length = F.col("t_to") - F.col("t_frm")
    aggs = []
    for v in values:
        w = F.when(F.col(v).isNotNull(), length * F.col(f"{v}_cover"))
        aggs.append(F.try_divide(F.sum(F.col(v) * w), F.sum(w)).alias(v))
    return composites.groupBy("hole_id", code).agg(F.sum(length).alias("length"), *aggs)


def code_order(rows: DataFrame) -> DataFrame:
    """code and rank by where it first appears: hole, then depth."""
    first = rows.groupBy("code").agg(F.min(F.struct("hole_id", "frm", "to")).alias("first"))
    return first.select("code", F.row_number().over(Window.orderBy("first", "code")).alias("rank"))


def overturned(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Holes where a bed lies above one of lower rank."""
    placed = rows.join(ranks, "code")
    before = F.lag("rank").over(Window.partitionBy("hole_id").orderBy("frm", "rank"))
    return placed.withColumn("turned", F.coalesce(F.col("rank") < before, F.lit(False))).groupBy("hole_id").agg(F.bool_or("turned").alias("overturned"), F.count("*").alias("n"))


def axis(holes: DataFrame, surveys: DataFrame) -> DataFrame:
    """hole_id, md, x, y, z along surveyed holes (azimuth, inclination from vertical) by minimum curvature arcs; straight up to the first station."""
    s = surveys.groupBy("hole_id", F.round("md", 6).alias("md")).agg(F.min_by(F.struct("azi", "inc"), F.struct("azi", "inc")).alias("o")).select("hole_id", "md", F.radians("o.azi").alias("a"), F.radians("o.inc").alias("i"))
    w = Window.partitionBy("hole_id").orderBy("md")
    prev = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    s = s.withColumn("a0", prev("a")).withColumn("i0", prev("i")).withColumn("step", F.col("md") - F.coalesce(F.lag("md").over(w), F.lit(0.0)))
    cosine = F.cos(F.col("i") - F.col("i0")) - F.sin("i0") * F.sin("i") * (1 - F.cos(F.col("a") - F.col("a0")))
    s = s.withColumn("beta", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))
    ratio = F.when(F.col("beta") < 1e-9, 1.0).otherwise(F.try_divide(2 * F.tan(F.col("beta") / 2), F.col("beta")))
    half = F.col("step") / 2 * ratio
    s = s.withColumn("dx", half * (F.sin("i0") * F.sin("a0") + F.sin("i") * F.sin("a"))).withColumn("dy", half * (F.sin("i0") * F.cos("a0") + F.sin("i") * F.cos("a"))).withColumn("dz", -half * (F.cos("i0") + F.cos("i")))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("hole_id", "md", *[F.sum(f"d{c}").over(run).alias(f"d{c}") for c in "xyz"])
    return s.join(holes.select("hole_id", "x", "y", "z"), "hole_id").select("hole_id", "md", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "xyz"])


def vertical_reference(surveys: DataFrame, band: float = 5.0) -> DataFrame:
    """reference: which inclination means vertical in a whole table of surveys (inc): the one of 0, -90 and 90 that most lie within ``band`` of, the first of equals.

    Where none is near any of them, -90 if some lie under -45, else 0; an empty table has 0.
    """
    v = F.col("inc").cast("double")
    known = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    n = lambda ref: F.count_if(known & (F.abs(v - ref) <= band))
    counts = surveys.agg(n(0.0).alias("up"), n(-90.0).alias("down"), n(90.0).alias("across"), F.min(F.when(known, v)).alias("least"))
    best = F.when(F.greatest("up", "down", "across") == 0, F.when(F.col("least") < -45, -90.0).otherwise(0.0))
    return counts.select(best.when(F.col("up") >= F.greatest("down", "across"), 0.0).when(F.col("down") >= F.col("across"), -90.0).otherwise(90.0).alias("reference"))


def surveyed(surveys: DataFrame, band: float = 5.0) -> DataFrame:
    """Surveys (hole_id, md, azi, inc) with inclinations from the vertical, whatever they were counted from; the first by azimuth and inclination of a depth."""
    zenith = F.when(F.col("reference") == 0, F.col("inc")).otherwise(90 - F.abs("inc"))
    found = surveys.crossJoin(F.broadcast(vertical_reference(surveys, band)))  # one row
    first = found.groupBy("hole_id", F.round("md", 6).alias("md")).agg(F.min(F.struct("azi", zenith.alias("inc"))).alias("o"))
    return first.select("hole_id", "md", "o.azi", "o.inc")
