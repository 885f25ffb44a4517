"""Further feeds: nested documents, tables and grids in text; malformed entries are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearby import neighbours
from .feeds import number

#: A well's value below this is missing, and the grid's mark of a missing value.
DRY, NO_VALUE = -900.0, 9999


def minute(text: Column) -> Column:
    """A time to the minute, with a T and a Z or with a blank, both UTC."""
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}Z?$"), F.concat(F.replace(F.substring(text, 1, 16), F.lit("T"), F.lit(" ")), F.lit(":00Z")))
    return plain.try_cast("timestamp")


def ejections(df: DataFrame, text: str = "text", keep: tuple = ()) -> DataFrame:
    """time and value, the speed of the first analysis that has one (not 0), of arrays of ejections."""
    e = df.select(*keep, F.inline(F.from_json(text, "array<struct<startTime:string,cmeAnalyses:array<struct<speed:double>>>>")))
    speed = F.get(F.filter(F.transform("cmeAnalyses", lambda a: a["speed"]), lambda s: s != 0), F.lit(0))
    return e.select(*keep, minute(F.col("startTime")).alias("time"), speed.alias("value")).where("time is not null and value is not null")


def storms(df: DataFrame, text: str = "text", keep: tuple = ()) -> DataFrame:
    """time and value of every planetary index observed in a storm."""
    e = df.select(*keep, F.inline(F.from_json(text, "array<struct<allKpIndex:array<struct<observedTime:string,kpIndex:double>>>>"))).select(*keep, F.inline("allKpIndex"))
    return e.select(*keep, minute(F.col("observedTime")).alias("time"), F.col("kpIndex").alias("value")).where("time is not null and value is not null")


WELLS = "value struct<timeSeries:array<struct<sourceInfo:struct<siteName:string,siteCode:array<struct<value:string>>,geoLocation:struct<geogLocation:struct<latitude:double,longitude:double>>>,values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"


def wells(df: DataFrame, text: str = "text") -> DataFrame:
    """site, name, lat, lon, time and value (depth of the water) of nested series by site; the first list of values of each counts."""
    s = df.select(F.explode(F.from_json(text, WELLS)["value"]["timeSeries"]).alias("s"))
    at = F.col("s.sourceInfo.geoLocation.geogLocation")
    s = s.select(F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site"), F.col("s.sourceInfo.siteName").alias("name"), at["latitude"].alias("lat"), at["longitude"].alias("lon"), F.explode(F.get("s.values", F.lit(0))["value"]).alias("v"))
    s = s.select(F.coalesce("site", F.lit("")).alias("site"), "name", "lat", "lon", F.col("v.dateTime").try_cast("timestamp").alias("time"), number(F.col("v.value")).alias("value"))
    return s.where(F.col("time").isNotNull() & (F.col("value") >= DRY))


def tides(df: DataFrame, text: str = "text") -> DataFrame:
    """station (a column of df), time and value of water levels."""
    e = df.select("station", F.explode(F.from_json(text, "data array<struct<t:string,v:string>>")["data"]).alias("e"))
    return e.select("station", minute(F.col("e.t")).alias("time"), number(F.col("e.v")).alias("value")).where("time is not null and value is not null")


def variations(df: DataFrame, text: str = "text") -> DataFrame:
    """station (a column of df), time, metric and value of one list of times and a list of values for each element."""
    d = df.select("station", F.from_json(text, "times array<string>, values array<struct<id:string,values:array<double>>>").alias("d"))
    e = d.select("station", "d.times", F.explode("d.values").alias("e")).select("station", F.concat(F.lit("mag_"), F.lower("e.id")).alias("metric"), F.inline(F.arrays_zip("times", F.col("e.values").alias("value"))))
    return e.select("station", F.col("times").try_cast("timestamp").alias("time"), "metric", "value").where("value is not null and time is not null")


def alerts(df: DataFrame, text: str = "text") -> DataFrame:
    """volcano, name, lat, lon, level and colour of a snapshot of elevated volcanoes; the last entry of a volcano counts."""
    e = df.select(F.posexplode(F.from_json(text, "array<struct<vnum:string,volcano_name_appended:string,latitude:double,longitude:double,alert_level:string,color_code:string>>")).alias("place", "e"))
    last = e.where("e.vnum is not null").groupBy(F.col("e.vnum").alias("volcano")).agg(F.max_by("e", "place").alias("e"))
    return last.select("volcano", F.col("e.volcano_name_appended").alias("name"), F.col("e.latitude").alias("lat"), F.col("e.longitude").alias("lon"), F.col("e.alert_level").alias("level"), F.col("e.color_code").alias("color"))


HOTSPOT = ("latitude", "longitude", "brightness", "bright_ti4", "frp", "acq_date", "acq_time", "satellite", "confidence")


def hotspots(df: DataFrame, text: str = "text") -> DataFrame:
    """lat, lon, brightness, power, date, time and satellite of tables with a header, whose columns may be in any order; brightness comes from either of its columns."""
    d = df.where(~F.col(text).rlike("transaction_limit|Invalid|Error|(?i)<html")).select(F.split(F.btrim(text), r"\r?\n").alias("lines"))
    d = d.select(F.split(F.get("lines", F.lit(0)), ",").alias("head"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    cells = F.split("line", ",")
    of = lambda name: F.get(cells, F.array_position("head", name).cast("int") - 1)
    has = lambda name: F.when(F.array_contains("head", name), F.nullif(of(name), F.lit("")))
    lat, lon, bright, frp = number(has("latitude")), number(has("longitude")), number(F.coalesce(has("brightness"), has("bright_ti4"), F.lit("0"))), number(F.coalesce(has("frp"), F.lit("0")))
    rows = d.select(lat.alias("lat"), lon.alias("lon"), bright.alias("brightness"), frp.alias("frp"), has("acq_date").alias("date"), has("acq_time").alias("time"), has("satellite").alias("satellite"))
    return rows.where("lat is not null and lon is not null and brightness is not null and frp is not null")


def attributed(spots: DataFrame, volcanoes: DataFrame, km: float = 100.0) -> DataFrame:
    """spots with the nearest of ``volcanoes`` (volcano, lat, lon) within ``km`` and its distance; others are left out.  Both sides meet by cells; of the volcanoes of one place the first stands for all."""
    volcanoes = volcanoes.groupBy("lat", "lon").agg(F.min("volcano").alias("volcano"))
    flat = lambda d: d.withColumn("ep", F.lit(0.0))
    near = neighbours(flat(spots.withColumn("row", F.struct(*spots.columns))), flat(volcanoes), km=km).where(F.col("km") < km)
    best = near.groupBy("l.row").agg(F.min(F.struct(F.col("km"), F.col("r.volcano").alias("volcano"))).alias("best"))
    return best.select("row.*", F.col("best.volcano").alias("volcano"), F.round("best.km", 1).alias("km"))


LAT_LINE = "LAT/LON1/LON2/DLON/H"


def tec_maps(spark: SparkSession, path: str) -> DataFrame:
    """file, time, lat, lon and value of the maps of electron content in exchange files.

    A file is read in pieces that end where a map ends, so that a large file is dealt out by its maps; the header (exponent and longitudes)
    is in the first piece of each file and is joined to the others by the file's name.  9999 is missing; a map that is cut off, and what is not a map of content, is left out."""
    pieces = spark.read.option("lineSep", "END OF TEC MAP").text(path).select(F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("text"))
    first = lambda pattern, k=1: F.regexp_extract("text", pattern, k)
    lons = r"(?m)^\s*(-?[\d.]+)\s+(-?[\d.]+)\s+(-?[\d.]+)[^\n]*LON1 / LON2 / DLON"
    head = pieces.where(F.col("text").contains("END OF HEADER")).select("file", F.coalesce(number(first(r"(?m)^\s*(-?\d+)[^\n]*EXPONENT")), F.lit(-1.0)).alias("exponent"), number(first(lons)).alias("west"), number(first(lons, 2)).alias("east"), number(first(lons, 3)).alias("step"))
    number_of = r"(?m)^\s*(\d+)\s+START OF TEC MAP"
    maps = pieces.where((first(number_of) != "") & (first(number_of) == F.regexp_extract("text", r"\n\s*(\d+)\s*$", 1)))
    epoch = first(r"(?m)^([\d .]+)EPOCH OF CURRENT MAP")
    parts = F.transform(F.split(F.btrim(epoch), r"\s+"), lambda x: number(x).cast("int"))
    time = F.when(F.size(parts) >= 6, F.make_timestamp(*(F.get(parts, F.lit(i)) for i in range(6))))
    lines = rf"(?m)^[ \t]*(-?\d+\.?\d*)[^\n]*{LAT_LINE}[^\n]*\n((?:[ \t\d-]*(?:\n|$))*)"
    rows = maps.select("file", time.alias("time"), F.inline(F.arrays_zip(F.regexp_extract_all("text", F.lit(lines), F.lit(1)).alias("lat"), F.regexp_extract_all("text", F.lit(lines), F.lit(2)).alias("values"))))
    rows = rows.select("file", "time", number(F.col("lat")).alias("lat"), F.posexplode(F.split(F.btrim("values", F.lit(" \t\n")), r"\s+")).alias("k", "v")).where("time is not null")
    # A row of a map ends at its last longitude: the number of the next marker is none of its values.
    rows = rows.join(head.where("step <> 0"), "file").where(F.col("k") <= F.round((F.col("east") - F.col("west")) / F.col("step")))
    value = number(F.col("v"))
    return rows.where(value.isNotNull() & (value != NO_VALUE)).select("file", "time", "lat", F.round(F.col("west") + F.col("k") * F.col("step"), 2).alias("lon"), F.round(value * F.pow(F.lit(10.0), "exponent"), 2).alias("value"))
