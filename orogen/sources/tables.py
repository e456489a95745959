"""Readers of drill, bed-reference, variogram and map tables, and raster files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.functions.scalar import number
from orogen.operators.kriging import Model

#: Column names under which a field may come, in lower case.
SYNONYMS = {
    "hole_id": ["hole_id", "hole", "holeid", "bhid", "well", "id"],
    "frm": ["frm", "from", "depth_from", "top_depth"],
    "to": ["to", "depth_to", "bottom_depth"],
    "code": ["code", "lith", "lithology", "bed"],
    "md": ["md", "depth", "at"],
    "azi": ["azi", "azimuth", "az"],
    "inc": ["inc", "dip", "zenith", "inclination"],
    "eoh": ["eoh", "depth_max", "total_depth"],
}


def resolve(columns: list[str], wanted: str, chosen: str | None = None) -> str | None:
    """The column that holds a field: the chosen one, or the first synonym, without regard to case."""
    lower = {c.lower().strip(): c for c in reversed(columns)}
    return lower.get(chosen.lower()) if chosen else next((lower[s] for s in SYNONYMS.get(wanted, [wanted]) if s in lower), None)


def read_table(spark: SparkSession, path: str, fields: dict[str, str], encoding: str = "UTF-8", separator: str = ",") -> DataFrame:
    """Fields (name to ``number`` or ``text``) of a CSV file under any of their synonyms; numbers take commas or points."""
    raw = spark.read.csv(path, header=True, sep=separator, encoding=encoding)
    out = []
    for name, kind in fields.items():
        found = resolve(raw.columns, name)
        column = F.col(f"`{found}`") if found else F.lit(None).cast("string")
        out.append((number(column) if kind == "number" else F.nullif(F.trim(column), F.lit(""))).alias(name))
    return raw.select(*out)


def identifier(column):
    """An id as text: whole numbers lose their decimals, blanks are null."""
    text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def bed_reference(rows: DataFrame) -> DataFrame:
    """Beds (code, order, body, color, strata, note) by order; the first row of a code, without regard to case and look-alike letters, stays.

    Rows may bring ``seq``, their place in the source; else they count in the order of one file as Spark reads it.
    """
    key = F.lower(F.translate(F.trim("code"), "АВЕКМНОРСТХавекмнорстх", "ABEKMHOPCTXabekmhopctx"))
    w = Window.partitionBy("key").orderBy("seq")
    ordered = rows.where(F.trim("code") != "").withColumn("seq", F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()).withColumn("key", key)
    color = F.when(F.col("color").rlike("^#?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.lower(F.regexp_replace("color", "#", ""))))
    return ordered.withColumn("k", F.row_number().over(w)).where("k = 1").select("code", "key", F.col("order").cast("int").alias("order"), "body", color.alias("color"), "strata", "note").orderBy("order", "seq")


def lookup_code(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows with the reference's order and body by code: as it is, or else by its folded key. The reference is one small table of beds."""
    key = F.lower(F.translate(F.trim("code"), "АВЕКМНОРСТХавекмнорстх", "ABEKMHOPCTXabekmhopctx"))
    exact = reference.select("code", F.col("order").alias("o1"), F.col("body").alias("b1"))
    folded = reference.select("key", F.col("order").alias("o2"), F.col("body").alias("b2"))
    return rows.withColumn("key", key).join(exact, "code", "left").join(folded, "key", "left").withColumn("order", F.coalesce("o1", "o2")).withColumn("body", F.coalesce("b1", "b2")).drop("o1", "o2", "b1", "b2", "key")


OSM = "elements ARRAY<STRUCT<type: STRING, id: BIGINT, tags: MAP<STRING, STRING>, lat: DOUBLE, lon: DOUBLE, geometry: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>>>"


def osm_elements(texts: DataFrame, column: str = "value") -> DataFrame:
    """id, kind (road, water, building, peak or null), name, elevation and vertices of a map extract's nodes and ways, from JSON text."""
    e = texts.select(F.explode(F.from_json(column, OSM).elements).alias("e")).select("e.*")
    tag = lambda k: F.col("tags")[k]
    kind = F.when(tag("highway").isNotNull(), "road").when(tag("waterway").isNotNull() | (tag("natural") == "water"), "water").when(tag("building").isNotNull(), "building").when(tag("natural") == "peak", "peak")
    points = F.coalesce("geometry", F.when(F.col("lat").isNotNull(), F.array(F.struct("lat", "lon"))))
    closed = (F.size(points) > 3) & (F.element_at(points, 1) == F.element_at(points, -1))
    return e.select("id", "type", kind.alias("kind"), tag("name").alias("name"), number(F.regexp_extract(F.coalesce(tag("ele"), F.lit("")), r"-?\d+(?:[.,]\d+)?", 0)).alias("ele"), closed.alias("closed"), points.alias("points"))


def tile_name(lat, lon):
    """South-west corner name of a one-degree elevation tile."""
    a, b = F.floor(lat), F.floor(lon)
    return F.concat(F.when(a >= 0, "N").otherwise("S"), F.lpad(F.abs(a).cast("string"), 2, "0"), F.when(b >= 0, "E").otherwise("W"), F.lpad(F.abs(b).cast("string"), 3, "0"))


def slippy_tile(lat, lon, zoom: int):
    """(x, y) of the web map tile that holds a place; latitudes are clipped to the projection's."""
    n = 2**zoom
    a = F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)))
    inside = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    return inside((lon + 180) / 360 * n), inside((1 - F.log(F.tan(a) + 1 / F.cos(a)) / 3.141592653589793) / 2 * n)


def utm_zone(lat, lon):
    """EPSG code of the zone a place falls in."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def land_points(spark: SparkSession, path: str, north_first: bool = True) -> DataFrame:
    """name, x, y, z of the CgPoint elements of land XML files; north comes first unless told otherwise."""
    raw = spark.read.format("xml").option("rowTag", "CgPoint").schema("_name STRING, _VALUE STRING").load(path)
    part = F.split(F.trim("_VALUE"), r"\s+")
    a, b = part[0].cast("double"), part[1].cast("double")
    x, y = (b, a) if north_first else (a, b)
    return raw.select(F.col("_name").alias("name"), x.alias("x"), y.alias("y"), F.try_element_at(part, F.lit(3)).cast("double").alias("z"))


def write_raster(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Cells as Parquet in folders of tile rows, so that a window of rows reads its folders only."""
    cells.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int")).repartition("tile_row").sortWithinPartitions("row", "col").write.partitionBy("tile_row").parquet(path)


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, tile: int = 256) -> DataFrame:
    got = spark.read.parquet(path)
    if rows:
        got = got.where(F.col("tile_row").between(rows[0] // tile, rows[1] // tile) & F.col("row").between(*rows))
    return got.drop("tile_row")


def merged(frames: list[DataFrame], reserved: tuple[str, ...] = ()) -> DataFrame:
    """One table of many, by column name: what a table lacks is null, ``reserved`` names get a suffix, and a column that comes in two types is text."""
    renamed = [f.withColumnsRenamed({c: f"{c}_1" for c in f.columns if c in reserved}) for f in frames]
    types: dict[str, set[str]] = {}
    for f in renamed:
        for c, t in f.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = [c for c, t in types.items() if len(t) > 1]
    out = None
    for f in renamed:
        f = f.withColumns({c: F.col(c).cast("string") for c in mixed if c in f.columns})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def manifest_merged(old: DataFrame, new: DataFrame, key: str = "layer") -> DataFrame:
    """Rows of two manifests by ``key``, each field the new one's where it has one."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: [F.col(f"{t}.{c}") for t, f in (("b", new), ("a", old)) if c in f.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), *[F.coalesce(*pick(c)).alias(c) for c in fields])


def section_order(table: DataFrame, number: str, seq: str) -> DataFrame:
    """Rows by the whole number that a field holds; those without one come last, in their own order."""
    n = F.col(number).cast("string").try_cast("int")
    return table.orderBy(n.isNull(), n, seq)


#: Metres in a unit of land XML.
UNITS = {"meter": 1.0, "millimeter": 0.001, "centimeter": 0.01, "kilometer": 1000.0, "foot": 0.3048, "USSurveyFoot": 1200 / 3937, "inch": 0.0254, "mile": 1609.344}


def _refused(spark: SparkSession, path: str) -> None:
    """Land XML files may not declare types or entities, which parsers might expand or fetch."""
    if not spark.read.text(path).where(F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)")).isEmpty():
        raise ValueError("a land XML file declares a document type or entities")


def land_unit(spark: SparkSession, path: str) -> float:
    """Metres in the files' linear unit; 1 where it isn't known."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", 'linearUnit\\s*=\\s*"([^"]*)"', 1).alias("u")).where("u <> ''").first()
    return UNITS.get(found["u"], 1.0) if found else 1.0


def land_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """surface, triangle and its corners x0 .. z2 of the TIN surfaces of land XML files (north first); hidden faces and those with unknown points are left out."""
    _refused(spark, path)
    unit = land_unit(spark, path)
    schema = "_name STRING, Definition STRUCT<Pnts: STRUCT<P: ARRAY<STRUCT<_id: STRING, _VALUE: STRING>>>, Faces: STRUCT<F: ARRAY<STRUCT<_i: STRING, _VALUE: STRING>>>>"
    raw = spark.read.format("xml").option("rowTag", "Surface").schema(schema).load(path).select(F.col("_name").alias("surface"), "Definition.*")
    part = F.split(F.trim("p._VALUE"), "\\s+")
    at = lambda k: part[k].cast("double") * unit
    points = raw.select("surface", F.explode("Pnts.P").alias("p")).select("surface", F.col("p._id").alias("id"), at(1).alias("x"), at(0).alias("y"), at(2).alias("z"))
    faces = raw.select("surface", F.posexplode("Faces.F").alias("triangle", "f")).where("coalesce(f._i, '') <> '1'")
    corners = faces.select("surface", "triangle", F.posexplode(F.split(F.trim("f._VALUE"), "\\s+")).alias("k", "id")).where("k < 3").join(points, ["surface", "id"])
    each = corners.groupBy("surface", "triangle").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"])
    return each.where("n = 3").drop("n")


def land_alignments(spark: SparkSession, path: str) -> DataFrame:
    """line (the alignment's name), seq, x and y of the straight elements of land XML alignments, with ``start``, the station of the first vertex."""
    _refused(spark, path)
    unit = land_unit(spark, path)
    schema = "_name STRING, _staStart DOUBLE, CoordGeom STRUCT<Line: ARRAY<STRUCT<Start: STRING, End: STRING>>>"
    raw = spark.read.format("xml").option("rowTag", "Alignment").schema(schema).load(path)
    line = raw.select(F.col("_name").alias("line"), (F.coalesce("_staStart", F.lit(0.0)) * unit).alias("start"), F.posexplode("CoordGeom.Line").alias("k", "l"))
    ends = line.select("line", "start", "k", F.posexplode(F.array("l.Start", "l.End")).alias("end", "p"))
    part = F.split(F.trim("p"), "\\s+")
    laid = ends.withColumns({"x": part[1].cast("double") * unit, "y": part[0].cast("double") * unit}).where("k = 0 or end = 1")
    return laid.select("line", "start", (F.col("k") + F.col("end")).alias("seq"), "x", "y")


def write_land_xml(triangles: DataFrame, path: str) -> None:
    """Surfaces (surface, triangle, x0 .. z2) as land XML in metres, north first: a file for each surface, written by Spark as text.

    Lines carry their place, so a sort within the surface's partition puts the file in order; corners that surfaces share are one point.
    """
    corner = F.explode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(3)])).alias("p")
    points = triangles.select("surface", corner).distinct()
    points = points.withColumn("id", F.row_number().over(Window.partitionBy("surface").orderBy("p.x", "p.y", "p.z")))
    named = triangles.select("surface", "triangle", F.posexplode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(3)])).alias("k", "p")).join(points, ["surface", "p"])
    faces = named.groupBy("surface", "triangle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"].cast("string")), " ").alias("ids"))
    line = lambda part, at, text: F.struct(F.lit(part).alias("part"), at.cast("long").alias("at"), text.alias("value"))
    head = F.concat(F.lit('<?xml version="1.0"?><LandXML version="1.2"><Units><Metric linearUnit="meter"/></Units><Surfaces><Surface name="'), F.regexp_replace(F.regexp_replace(F.col("surface").cast("string"), "&", "&amp;"), '["<>]', ""), F.lit('"><Definition surfType="TIN"><Pnts>'))
    text = triangles.select("surface").distinct().select("surface", F.explode(F.array(line(0, F.lit(0), head), line(2, F.lit(0), F.lit("</Pnts><Faces>")), line(4, F.lit(0), F.lit("</Faces></Definition></Surface></Surfaces></LandXML>")))).alias("l"))
    text = text.union(points.select("surface", line(1, F.col("id"), F.format_string('<P id="%d">%.6f %.6f %.6f</P>', "id", "p.y", "p.x", "p.z"))))
    text = text.union(faces.select("surface", line(3, F.col("triangle"), F.format_string("<F>%s</F>", "ids"))))
    out = text.select("surface", "l.*").repartition("surface").sortWithinPartitions("surface", "part", "at")
    out.select("surface", "value").write.mode("overwrite").partitionBy("surface").text(path)


# ----- variogram tables ---------------------------------------------------------------------

#: Names of variogram structures, in lower case.
STRUCTURES = {
    "spherical": ["сферическая", "spherical", "sph", "1"],
    "exponential": ["экспоненциальная", "exponential", "exp", "2"],
    "gaussian": ["гауссова", "gaussian", "gau", "3"],
    "power": ["степенная", "power", "pow", "4"],
}
#: Words for yes in a table's flags.
YES = ["1", "true", "да", "yes", "y", "истина", "t"]


def variogram_structures(rows: DataFrame) -> DataFrame:
    """seq, profile, struct, kind, sill, range, azimuth, anis, nugget, val_pct, val_cap and note of a table of variogram models.

    Rows bring profile, struct, model, sill and range, any of azimuth, anis, nugget, val_pct and val_cap, and ``seq``, their place in the table; names of
    columns go without case. A row without a profile, a known model, a sill of 0 or more, or a range above 0 has a null kind and says why in ``note``; so
    has a second row of a structure. An anisotropy of 0 or less counts as 1. Of a profile's nuggets and filters the first row's hold; rows that differ say so.
    """
    have = {c.strip().lower(): c for c in rows.columns}
    text = lambda c: F.trim(F.col(f"`{have[c]}`").cast("string")) if c in have else F.lit(None).cast("string")
    code = F.lower(text("model"))
    kind = F.coalesce(*[F.when(code.isin(names), k) for k, names in STRUCTURES.items()])
    n = {c: number(text(c)) for c in ("struct", "sill", "range", "azimuth", "anis", "nugget", "val_pct")}
    wrong = (
        F.when(F.coalesce(text("profile"), F.lit("")) == "", "no profile").when(kind.isNull(), "unknown model")
        .when(F.coalesce(n["sill"], F.lit(-1.0)) < 0, "sill isn't 0 or more").when(F.coalesce(n["range"], F.lit(0.0)) <= 0, "range isn't above 0")
    )
    struct = F.when(F.coalesce(n["struct"], F.lit(0.0)) == 0, 1.0).otherwise(n["struct"]).cast("int")
    t = rows.select(
        F.col(f"`{have['seq']}`").alias("seq"), text("profile").alias("profile"), struct.alias("struct"), kind.alias("kind"), n["sill"].alias("sill"), n["range"].alias("range"),
        F.coalesce(n["azimuth"], F.lit(0.0)).alias("azimuth"), n["anis"].alias("given"), F.when(n["anis"] > 0, n["anis"]).otherwise(1.0).alias("anis"),
        n["nugget"].alias("nugget"), n["val_pct"].alias("val_pct"), F.coalesce(F.lower(text("val_cap")).isin(YES), F.lit(False)).alias("val_cap"), wrong.alias("wrong"),
    )
    own = Window.partitionBy("profile", F.col("wrong").isNull()).orderBy("seq")
    first = lambda c: F.first(c).over(own)
    again = F.row_number().over(Window.partitionBy("profile", "struct", F.col("wrong").isNull()).orderBy("seq")) > 1
    t = t.withColumn("again", again & F.col("wrong").isNull()).withColumns({f"{c}1": F.coalesce(first(c), F.lit(0.0)) for c in ("nugget", "val_pct")}).withColumn("val_cap1", first("val_cap"))
    differs = lambda c: F.when((F.abs(F.col(c) - F.col(f"{c}1")) > 1e-9), f"{c} differs from the profile's first")
    note = F.coalesce("wrong", F.when(F.col("again"), "structure stands twice"), differs("nugget"), differs("val_pct"), F.when(F.col("given") <= 0, "anisotropy taken as 1"))
    good = F.col("wrong").isNull() & ~F.col("again")
    keep = lambda c: F.when(good, F.col(c))
    return t.select("seq", "profile", "struct", keep("kind").alias("kind"), "sill", "range", "azimuth", "anis", F.col("nugget1").alias("nugget"), F.col("val_pct1").alias("val_pct"), F.col("val_cap1").alias("val_cap"), note.alias("note"))


def variogram_models(structures: DataFrame) -> dict[str, Model]:
    """The models of ``variogram_structures`` by profile: the parameters of estimates, one small table."""
    out: dict[str, Model] = {}
    for r in structures.where("kind is not null").orderBy("profile", F.desc("struct"), F.desc("seq")).collect():
        after = out.get(r["profile"])
        out[r["profile"]] = Model(r["kind"], r["sill"], r["range"], r["nugget"], r["azimuth"], r["anis"], () if after is None else (replace(after, nested=()), *after.nested))
    return out
