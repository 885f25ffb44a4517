"""Parsers of raw feeds: a DataFrame with a column of text in, typed rows out.

Each is a projection with from_json, split or regular expressions; malformed rows are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOJSON = "features array<struct<id:string,properties:struct<mag:double,time:bigint,place:string>,geometry:struct<coordinates:array<double>>>>"


def number(text: Column) -> Column:
    return F.btrim(text).try_cast("double")


def geojson_quakes(df: DataFrame, text: str = "text") -> DataFrame:
    """id, ep, magnitude, depth_km, lat, lon, place of FeatureCollections; features without magnitude or time are skipped."""
    f = df.select(F.inline(F.from_json(text, GEOJSON).features)).where("properties.mag is not null and properties.time is not null")
    at = F.col("geometry.coordinates")
    return f.select("id", (F.col("properties.time") / 1000.0).alias("ep"), F.col("properties.mag").alias("magnitude"), F.get(at, F.lit(2)).alias("depth_km"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), "properties.place")


AGENCY = "features array<struct<id:string,properties:struct<mag:double,time:string,source_id:string,unid:string,flynn_region:string,region:string>,geometry:struct<coordinates:array<double>>>>"


def agency_quakes(df: DataFrame, text: str = "text") -> DataFrame:
    """id, ep, magnitude, depth_km, lat, lon, place of FeatureCollections with ISO times; features without magnitude or a time that can be read are skipped.

    An empty string counts as missing: the id is the first of source_id, unid and the feature's own, the place the first of both regions."""
    f = df.select(F.inline(F.from_json(text, AGENCY).features)).select("id", "properties.*", F.col("geometry.coordinates").alias("at"))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    f = f.withColumn("time", F.col("time").try_cast("timestamp")).where("mag is not null and time is not null")
    return f.select(F.concat(F.lit("emsc_"), first("source_id", "unid", "id")).alias("id"), (F.unix_micros("time") / 1e6).alias("ep"), F.col("mag").alias("magnitude"), F.get("at", F.lit(2)).alias("depth_km"), F.get("at", F.lit(1)).alias("lat"), F.get("at", F.lit(0)).alias("lon"), first("flynn_region", "region").alias("place"))


def pipe_catalog(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of an FDSN text catalog: 13 fields between bars, comments and short rows left out."""
    line = df.select(F.explode(F.split(text, r"\r?\n")).alias("line")).where("line <> '' and line not like '#%'")
    p = F.split("line", r"\|")
    rows = line.select(p.alias("p")).where(F.size("p") >= 13)
    rows = rows.select(F.concat(F.lit("emsc:"), F.col("p")[0]).alias("id"), F.col("p")[1].try_cast("timestamp").alias("event_time"), number(F.col("p")[2]).alias("lat"), number(F.col("p")[3]).alias("lon"), number(F.col("p")[4]).alias("depth_km"), number(F.col("p")[10]).alias("magnitude"), F.col("p")[12].alias("place"))
    return rows.where("event_time is not null and magnitude is not null and lat is not null and lon is not null")


def header_array(df: DataFrame, text: str = "text") -> DataFrame:
    """Arrays of arrays whose first row is a header (time first), to narrow rows time, metric, value; nulls left out."""
    rows = df.select(F.from_json(text, "array<array<string>>").alias("a")).select(F.get("a", F.lit(0)).alias("head"), F.explode(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0)))).alias("r"))
    cells = rows.select(F.get("r", F.lit(0)).try_cast("timestamp").alias("time"), F.inline(F.slice(F.arrays_zip("head", "r"), F.lit(2), F.greatest(F.size("head") - 1, F.lit(0)))))
    return cells.select("time", F.col("head").alias("metric"), number(F.col("r")).alias("value")).where("value is not null and time is not null")


def tagged(df: DataFrame, fields: dict[str, str], text: str = "text", keep: tuple | list = ()) -> DataFrame:
    """Arrays of objects with a ``time_tag`` (UTC if it names no zone) to narrow rows time, metric, value; fields maps an object's
    fields to metrics, such as the planetary index, the ring current or fluxes; columns of ``keep`` come along.  Missing values and times that can't be read are left out."""
    m = df.select(*keep, F.explode(F.from_json(text, "array<map<string,string>>")).alias("m"))
    tag = F.col("m")["time_tag"]
    time = F.when(tag.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), tag).otherwise(F.concat(tag, F.lit("Z"))).try_cast("timestamp")
    cells = m.select(*keep, time.alias("time"), F.inline(F.array(*(F.struct(F.lit(metric).alias("metric"), number(F.col("m")[field]).alias("value")) for field, metric in fields.items()))))
    return cells.where("value is not null and time is not null")


def three_hour_kp(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines ``yyyy mm dd`` and eight three-hour values in tenths: time, value; negative values are missing."""
    f = F.split(F.btrim("line"), r"\s+")
    lines = df.select(F.explode(F.split(text, r"\r?\n")).alias("line")).where("line rlike '^ *[0-9]'").select(f.alias("f")).where(F.size("f") >= 11)
    cells = lines.select(F.make_timestamp(F.col("f")[0].try_cast("int"), F.col("f")[1].try_cast("int"), F.col("f")[2].try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("day"), F.posexplode(F.slice("f", 4, 8)).alias("k", "v"))
    return cells.select((F.col("day") + F.make_interval(hours=F.col("k") * 3)).alias("time"), (number(F.col("v")) / 10).alias("value")).where("value >= 0")


def buoy_heights(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines ``yy mm dd hh mi ss mode height``: station, time, mode, height; heights above 9000 are missing."""
    f = F.split(F.btrim("line"), r"\s+")
    lines = df.select("station", F.explode(F.split(text, r"\r?\n")).alias("line")).where("line rlike '^ *[0-9]'").select("station", f.alias("f")).where(F.size("f") >= 8)
    year = F.col("f")[0].try_cast("int")
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    parts = [F.col("f")[i].try_cast("int") for i in range(1, 6)]
    return lines.select("station", F.make_timestamp(year, *parts).alias("time"), F.col("f")[6].try_cast("int").alias("mode"), number(F.col("f")[7]).alias("height")).where("height <= 9000 and time is not null")


#: Letters of flare classes, weakest first.
FLARES = "ABCMX"


def flare_size(flare: Column) -> Column:
    """Class letter 1 to 5 and a tenth of the number; 1.0 if it can't be read."""
    letter = F.expr("0")
    for place, name in enumerate(FLARES, 1):
        letter = F.when(F.upper(F.substring(flare, 1, 1)) == name, place).otherwise(letter)
    return F.when(letter > 0, letter + number(F.substring(flare, F.lit(2), F.length(flare))) / 10).otherwise(F.lit(None)).cast("double")


def flares(df: DataFrame, text: str = "text") -> DataFrame:
    f = df.select(F.inline(F.from_json(text, "array<struct<beginTime:string,classType:string>>")))
    return f.select(F.col("beginTime").try_cast("timestamp").alias("time"), F.coalesce(flare_size(F.col("classType")), F.lit(1.0)).alias("value")).where("time is not null")


def hourly_wind(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines year, day of year, hour, field, speed, Kp in tenths; fill values (999.9, 9999, 99) are missing; narrow rows."""
    f = F.split(F.btrim("line"), r"\s+")
    r = df.select(F.explode(F.split(text, r"\r?\n")).alias("line")).select(f.alias("f")).where(F.size("f") >= 6)
    day = F.make_timestamp(F.col("f")[0].try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_interval(days=F.col("f")[1].try_cast("int") - 1, hours=F.col("f")[2].try_cast("int"))
    wide = r.select(day.alias("time"), *(F.when(number(F.col("f")[i]) < fill, number(F.col("f")[i]) / over).alias(name) for i, name, fill, over in ((3, "bz", 999.0, 1), (4, "speed", 9999.0, 1), (5, "kp", 99.0, 10))))
    return wide.unpivot("time", ["bz", "speed", "kp"], "metric", "value").where("value is not null and time is not null")
