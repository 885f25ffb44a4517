"""Feeds written from the tables, with entries that are wrong or missing, and parsed again; sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators.graph import shared_dir
from ..sources import feeds, reports, sinks
from ..sources.projection import DAY, QUAKES, SAMPLES, quakes, samples, stations
from .registry import query
from .series import ZONED, zoned

K = F.col


def stamp(ep, form: str):
    return F.date_format(F.timestamp_seconds(ep), form)


def lines(df, page, line, head: str | None = None, last: str = ""):
    """text: the lines of each page, after ``head``."""
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    text = body if head is None else F.concat(F.lit(head + "\n"), body)
    return df.groupBy(page.alias("page")).agg(F.concat(text, F.lit(last)).alias("text"))


def documents(df, page, entry):
    return df.groupBy(page.alias("page")).agg(F.to_json(F.collect_list(entry)).alias("text"))


def out(df, *names):
    return df.select(F.unix_seconds("time").alias("t"), *names)


MINUTES = "m AS (SELECT event_id, metric, CAST(floor(ep / 60) AS BIGINT) * 60 AS t, value FROM samples)"


def minutes(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", "metric", (F.floor(K("ep") / 60) * 60).alias("t"), "value")


@query(f"WITH {SAMPLES}, {MINUTES} SELECT t, round(300 + value, 1) AS value FROM m WHERE event_id % 4 <> 0 AND event_id % 9 <> 0")
def feed_ejections(spark, sf_dir):
    """Ejections with several analyses, the first without a speed; some without any, some with a time that can't be read."""
    m = minutes(spark, sf_dir)
    none = F.lit(None).cast("double")
    speeds = F.when(K("event_id") % 4 == 0, F.array(none, F.lit(0.0))).otherwise(F.array(none, F.round(300 + K("value"), 1), F.lit(1.0)))
    entry = F.struct(F.when(K("event_id") % 9 == 0, "soon").otherwise(stamp(K("t"), "yyyy-MM-dd'T'HH:mm'Z'")).alias("startTime"), F.transform(speeds, lambda s: F.struct(s.alias("speed"))).alias("cmeAnalyses"))
    return out(reports.ejections(documents(m, F.floor(K("event_id") / 40), entry)), "value")


@query(f"WITH {SAMPLES}, {MINUTES} SELECT t, round(value / 50, 4) AS value FROM m WHERE event_id % 6 <> 0")
def feed_storms(spark, sf_dir):
    """Storms with all their indices, some missing."""
    m = minutes(spark, sf_dir).withColumn("storm", F.floor(K("event_id") / 7))
    index = F.struct(stamp(K("t"), "yyyy-MM-dd'T'HH:mm'Z'").alias("observedTime"), F.when(K("event_id") % 6 != 0, F.round(K("value") / 50, 4)).alias("kpIndex"))
    storm = m.groupBy("storm").agg(F.collect_list(index).alias("allKpIndex"))
    return out(reports.storms(documents(storm, F.floor(K("storm") / 10), F.struct("allKpIndex"))), "value")


@query(f"""WITH {SAMPLES} SELECT CAST(floor(ep) AS BIGINT) AS t, CASE WHEN event_id % 8 = 0 THEN 1.0 ELSE CASE substr('ABCMX', 1 + event_id % 5, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'M' THEN 4 ELSE 5 END + (event_id % 90) / 10.0::DOUBLE / 10 END AS value FROM samples""")
def feed_flares(spark, sf_dir):
    """Flares with a letter and a number; classes that can't be read count as 1."""
    s = samples(spark, sf_dir)
    letter = F.substring(F.lit("ABCMX"), (K("event_id") % 5 + 1).cast("int"), F.lit(1))
    kind = F.when(K("event_id") % 8 == 0, "?").otherwise(F.concat(letter, (K("event_id") % 90 / 10).cast("string")))
    text = documents(s, F.floor(K("event_id") / 30), F.struct(stamp(F.floor("ep"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("beginTime"), kind.alias("classType")))
    return out(feeds.flares(text), "value")


@query(f"WITH {SAMPLES} SELECT metric AS site, event_id % 50 AS lat, CAST(floor(ep) AS BIGINT) AS t, round(value, 2) AS value FROM samples WHERE event_id % 5 <> 0 AND event_id % 11 <> 0")
def feed_wells(spark, sf_dir):
    """Nested series by site, with values that mark a dry well and values that are no numbers."""
    s = samples(spark, sf_dir).withColumns({"lat": (K("event_id") % 50).cast("double"), "page": F.floor(K("event_id") / 200)})
    text = F.when(K("event_id") % 5 == 0, "-999").when(K("event_id") % 11 == 0, "Ice").otherwise(F.round("value", 2).cast("string"))
    entry = F.struct(text.alias("value"), stamp(F.floor("ep"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("dateTime"))
    site = s.groupBy("page", "metric", "lat").agg(F.collect_list(entry).alias("value"))
    info = F.struct(K("metric").alias("siteName"), F.array(F.struct(K("metric").alias("value"))).alias("siteCode"), F.struct(F.struct(K("lat").alias("latitude"), F.lit(0.0).alias("longitude")).alias("geogLocation")).alias("geoLocation"))
    series = F.struct(info.alias("sourceInfo"), F.array(F.struct("value")).alias("values"))
    text = site.groupBy("page").agg(F.to_json(F.struct(F.struct(F.collect_list(series).alias("timeSeries")).alias("value"))).alias("text"))
    return out(reports.wells(text), "site", K("lat").cast("long").alias("lat"), "value")


@query(f"WITH {SAMPLES}, {MINUTES} SELECT metric AS station, t, round(value / 100, 4) AS value FROM m WHERE event_id % 10 <> 0")
def feed_tides(spark, sf_dir):
    """Water levels by station, some empty."""
    m = minutes(spark, sf_dir)
    entry = F.struct(stamp(K("t"), "yyyy-MM-dd HH:mm").alias("t"), F.when(K("event_id") % 10 == 0, "").otherwise(F.round(K("value") / 100, 4).cast("string")).alias("v"))
    text = m.groupBy(K("metric").alias("station"), F.floor(K("event_id") / 60).alias("page")).agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("text"))
    return out(reports.tides(text), "station", "value")


@query(f"WITH {SAMPLES} SELECT metric AS station, 'mag_x' AS metric, CAST(floor(ep) AS BIGINT) AS t, round(value, 2) AS value FROM samples UNION ALL SELECT metric, 'mag_z', CAST(floor(ep) AS BIGINT), round(-value, 2) FROM samples WHERE event_id % 3 <> 0")
def feed_variations(spark, sf_dir):
    """One list of times and a list of values for each element, with gaps."""
    s = samples(spark, sf_dir)
    row = F.struct("event_id", stamp(F.floor("ep"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.round("value", 2).alias("x"), F.when(K("event_id") % 3 != 0, F.round(-K("value"), 2)).alias("z"))
    g = s.groupBy(K("metric").alias("station"), F.floor(K("event_id") / 100).alias("page")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    element = lambda name: F.struct(F.lit(name.upper()).alias("id"), F.transform("r", lambda r: r[name]).alias("values"))
    text = g.select("station", F.to_json(F.struct(F.transform("r", lambda r: r["t"]).alias("times"), F.array(element("x"), element("z")).alias("values")), {"ignoreNullFields": "false"}).alias("text"))
    return out(reports.variations(text), "station", "metric", "value")


@query(f"""WITH {SAMPLES}, v AS (SELECT event_id % 40 AS volcano, max(event_id) AS last FROM samples WHERE event_id % 13 <> 0 GROUP BY 1) SELECT CAST(volcano AS VARCHAR) AS volcano, CAST(volcano AS DOUBLE) AS lat, CASE last % 3 WHEN 0 THEN 'ADVISORY' WHEN 1 THEN 'WATCH' ELSE 'WARNING' END AS level FROM v""")
def feed_alerts(spark, sf_dir):
    """A snapshot of elevated volcanoes in which a volcano comes again, and some have no number; the last entry counts."""
    s = samples(spark, sf_dir)
    level = F.element_at(F.array(*map(F.lit, ("ADVISORY", "WATCH", "WARNING"))), (K("event_id") % 3 + 1).cast("int"))
    entry = F.struct("event_id", F.when(K("event_id") % 13 != 0, (K("event_id") % 40).cast("string")).alias("vnum"), (K("event_id") % 40).cast("double").alias("latitude"), level.alias("alert_level"))
    # A snapshot is one document by nature; each volcano's entries are in one.
    g = s.groupBy((K("event_id") % 40).alias("page")).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("text"))
    return reports.alerts(g).select("volcano", "lat", "level")


VOLCANOES = "volcanoes AS (SELECT CAST(s_suppkey AS BIGINT) AS volcano, CAST(-60.0 + (s_suppkey * 41) % 120 AS DOUBLE) AS lat, CAST(-180.0 + (s_suppkey * 67) % 360 AS DOUBLE) AS lon FROM supplier)"


@query(f"""WITH {QUAKES}, {VOLCANOES}, h AS (SELECT event_id, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(magnitude * 100, 1) END AS brightness, depth_km AS frp FROM quakes WHERE event_id % 7 <> 0),
d AS (SELECT h.*, volcano, {haversine_sql("h", "v")} AS km FROM h JOIN volcanoes v ON abs(h.lat - v.lat) < 1)
SELECT lat, lon, brightness, frp, arg_min(volcano, struct_pack(a := km, b := volcano)) AS volcano, round(min(km), 1) AS km FROM d WHERE km < 100 GROUP BY event_id, lat, lon, brightness, frp""")
def feed_hotspots(spark, sf_dir):
    """Tables of hot spots of two instruments with columns of their own and lines that are no rows, and the volcano near which each spot is."""
    q = quakes(spark, sf_dir)
    bright = F.when(K("event_id") % 3 == 0, "").otherwise(F.round(K("magnitude") * 100, 1).cast("string"))
    lat, lon = (F.when(K("event_id") % 7 == 0, "n/a").otherwise(F.round(c, 4).cast("string")) for c in ("lat", "lon"))
    text = None
    for kind, columns, row in ((0, "latitude,longitude,brightness,frp,acq_date", F.concat_ws(",", lat, lon, bright, "depth_km", K("event_id").cast("string"))), (1, "frp,acq_date,bright_ti4,longitude,latitude", F.concat_ws(",", "depth_km", K("event_id").cast("string"), bright, lon, lat))):
        part = lines(q.where(K("event_id") % 2 == kind), F.floor(K("event_id") / 80), row, columns)
        text = part if text is None else text.union(part)
    volcanoes = stations(spark, sf_dir).withColumnRenamed("station", "volcano")
    return reports.attributed(reports.hotspots(text), volcanoes).select("lat", "lon", "brightness", "frp", "volcano", "km")


LATS, LONS = (40.0, 20.0, -20.0), (-180.0, 180.0, 60.0)
TEC = f"""{SAMPLES}, c AS (SELECT CAST(floor(ep / {DAY}) AS BIGINT) AS day, CAST(floor(ep / 21600) AS BIGINT) % 4 AS quarter, event_id % 3 AS i, event_id % 7 AS j, CAST(floor(max(value)) AS BIGINT) AS v FROM samples GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {TEC} SELECT day * 86400 + quarter * 21600 AS t, CASE i WHEN 0 THEN {LATS[0]}::DOUBLE WHEN 1 THEN {LATS[1]}::DOUBLE ELSE {LATS[2]}::DOUBLE END AS lat, -180.0::DOUBLE + j * 60 AS lon, round(v * 0.1::DOUBLE, 2) AS value FROM c""")
def feed_tec_maps(spark, sf_dir):
    """A file a day with four maps of three rows, wrapped after five values; cells without samples are missing.  Maps of error follow, and are none."""
    c = samples(spark, sf_dir).groupBy(F.floor(K("ep") / DAY).alias("day"), (F.floor(K("ep") / 21600) % 4).alias("quarter"), (K("event_id") % 3).alias("i"), (K("event_id") % 7).alias("j")).agg(F.floor(F.max("value")).alias("v"))
    cells = F.map_from_entries(F.collect_list(F.struct((K("i") * 7 + K("j")).cast("int"), F.lpad(K("v").cast("string"), 5, " "))))
    m = c.groupBy("day", "quarter").agg(cells.alias("cells"))
    values = lambda i: F.concat_ws("\n", *(F.concat(*(F.coalesce(K("cells")[i * 7 + j], F.lit(" 9999")) for j in part)) for part in (range(5), range(5, 7))))
    rows = [F.concat(F.lit(f"  {lat:6.1f}-180.0 180.0  60.0 450.0{'':28}{reports.LAT_LINE}\n"), values(i)) for i, lat in enumerate(LATS)]
    at = F.concat(F.date_format(F.timestamp_seconds(K("day") * 86400), "yyyy    MM    dd"), F.lpad((K("quarter") * 6).cast("string"), 6, " "), F.lit("     0     0                        EPOCH OF CURRENT MAP"))
    body = lambda kind: F.concat_ws("\n", F.concat(F.lpad((K("quarter") + 1).cast("string"), 6, " "), F.lit(f"{'':54}START OF {kind} MAP")), F.concat(F.lit("  "), at), *rows, F.concat(F.lpad((K("quarter") + 1).cast("string"), 6, " "), F.lit(f"{'':54}END OF {kind} MAP")))
    header = "\n".join([f"     1.0            IONOSPHERE MAPS{'':25}IONEX VERSION / TYPE", f"    -1{'':54}EXPONENT", f"  -180.0 180.0  60.0{'':40}LON1 / LON2 / DLON", f"{'':60}END OF HEADER"])
    joined = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("quarter", body(kind).alias("b")))), lambda x: x["b"]), "\n")
    f = m.groupBy("day").agg(F.concat_ws("\n", F.lit(header), joined("TEC"), joined("RMS"), F.lit(f"{'':60}END OF FILE")).alias("value"))
    path = shared_dir(spark, "maps")
    f.repartition("day").write.partitionBy("day").text(path)
    return out(reports.tec_maps(spark, f"{path}/*"), "lat", "lon", "value")


@query(f"WITH {QUAKES} SELECT 'emsc:' || event_id AS id, CAST(floor(ep) AS BIGINT) AS t, magnitude, lat, lon, depth_km FROM quakes WHERE event_id % 6 <> 0 AND event_id % 10 <> 0")
def feed_pipe_catalog(spark, sf_dir):
    """A catalogue of lines between bars, with comments, rows without magnitude and short rows."""
    q = quakes(spark, sf_dir)
    k = K("event_id").cast("string")
    m = F.when(K("event_id") % 6 == 0, "").otherwise(K("magnitude").cast("string"))
    line = F.when(K("event_id") % 10 == 0, F.concat(k, F.lit("|short"))).otherwise(F.concat_ws("|", k, stamp(F.floor("ep"), "yyyy-MM-dd'T'HH:mm:ss"), K("lat").cast("string"), K("lon").cast("string"), K("depth_km").cast("string"), *map(F.lit, "abcd"), F.lit("ml"), m, F.lit("x"), F.lit("PLACE")))
    got = feeds.pipe_catalog(lines(q, F.floor(K("event_id") / 100), line, "#EventID | Time | Latitude"))
    return got.select("id", F.unix_seconds("event_time").alias("t"), "magnitude", "lat", "lon", "depth_km")


@query(f"WITH {SAMPLES}, w AS (SELECT event_id, CAST(floor(ep) AS BIGINT) AS t, round(value, 2) AS a, round(value / 3, 2) AS b FROM samples) SELECT t, 'density' AS metric, a AS value FROM w UNION ALL SELECT t, 'speed', b FROM w WHERE event_id % 4 <> 0")
def feed_header_array(spark, sf_dir):
    """Arrays of arrays with a header row, some values null."""
    s = samples(spark, sf_dir)
    row = F.array(stamp(F.floor("ep"), "yyyy-MM-dd HH:mm:ss.SSS"), F.round("value", 2).cast("string"), F.when(K("event_id") % 4 != 0, F.round(K("value") / 3, 2).cast("string")))
    text = s.groupBy(F.floor(K("event_id") / 50).alias("page")).agg(F.to_json(F.concat(F.array(F.array(*map(F.lit, ("time_tag", "density", "speed")))), F.collect_list(row))).alias("text"))
    return out(feeds.header_array(text), "metric", "value")


@query(f"""WITH {SAMPLES}, d AS (SELECT CAST(floor(ep / {DAY}) AS BIGINT) AS day, CAST(floor(ep / 10800) AS BIGINT) % 8 AS k, count(*) AS n FROM samples GROUP BY 1, 2) SELECT day * 86400 + k * 10800 AS t, n / 10 AS value FROM d""")
def feed_three_hours(spark, sf_dir):
    """A line a day of eight values in tenths; where there is none, -1."""
    d = samples(spark, sf_dir).groupBy(F.floor(K("ep") / DAY).alias("day"), (F.floor(K("ep") / 10800) % 8).cast("int").alias("k")).agg(F.count("*").alias("n"))
    d = d.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("n"))
    line = F.concat_ws(" ", stamp(K("day") * 86400, "yyyy MM dd"), *(F.coalesce(K("n")[k], F.lit(-1)).cast("string") for k in range(8)))
    return out(feeds.three_hour_kp(lines(d, F.floor(K("day") / 10), line, "# indices")), "value")


@query(f"WITH {SAMPLES} SELECT metric AS station, CAST(floor(ep) AS BIGINT) AS t, CAST(1 + event_id % 3 AS INT) AS mode, round(4000 + value, 3) AS height FROM samples WHERE event_id % 9 <> 0")
def feed_buoys(spark, sf_dir):
    """Lines of heights by buoy with two digits of the year, some filled with 9999."""
    s = samples(spark, sf_dir)
    line = F.concat_ws(" ", stamp(F.floor("ep"), "yy MM dd HH mm ss"), (1 + K("event_id") % 3).cast("string"), F.when(K("event_id") % 9 == 0, "9999.000").otherwise(F.round(4000 + K("value"), 3).cast("string")))
    body = F.concat(F.lit("#YY  MM DD hh mm ss T   HEIGHT\n"), F.array_join(F.collect_list(line), "\n"))
    text = s.groupBy(K("metric").alias("station"), F.floor(K("event_id") / 100).alias("page")).agg(body.alias("text"))
    return out(feeds.buoy_heights(text), "station", "mode", "height")


@query(f"""WITH {SAMPLES}, h AS (SELECT CAST(floor(ep / 3600) AS BIGINT) * 3600 AS t, count(*) AS n, round(max(value), 1) AS v FROM samples GROUP BY 1), r AS (SELECT t, 'bz' AS metric, CASE WHEN n % 4 <> 0 THEN -v / 10 END AS value FROM h UNION ALL SELECT t, 'speed', v FROM h UNION ALL SELECT t, 'kp', CASE WHEN n < 99 THEN n / 10 END FROM h)
SELECT t, metric, round(value, 6) AS value FROM r WHERE value IS NOT NULL""")
def feed_hourly_wind(spark, sf_dir):
    """Lines of year, day of the year and hour; fill values of each column."""
    h = samples(spark, sf_dir).groupBy((F.floor(K("ep") / 3600) * 3600).alias("t")).agg(F.count("*").alias("n"), F.round(F.max("value"), 1).alias("v"))
    bz = F.when(K("n") % 4 == 0, "999.9").otherwise((-K("v") / 10).cast("string"))
    line = F.concat_ws(" ", stamp(K("t"), "yyyy D H"), bz, K("v").cast("string"), F.least(K("n"), F.lit(99)).cast("string"))
    got = feeds.hourly_wind(lines(h, F.floor(K("t") / (30 * DAY)), line))
    return out(got, "metric", F.round("value", 6).alias("value"))


@query(f"WITH {QUAKES} SELECT CAST(year(to_timestamp(ep)) AS INT) AS year, count(*) AS n, max(magnitude) AS top FROM quakes GROUP BY 1")
def sink_by_year(spark, sf_dir):
    """Events written by year and read again, one year's folder at a time."""
    path = shared_dir(spark, "years")
    sinks.by_year(quakes(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(K("year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.max("magnitude").alias("top"))


@query(f"WITH {ZONED}, h AS (SELECT CAST(floor(ep / 3600) AS BIGINT) AS hour, arg_max(event_id, struct_pack(a := ep, b := event_id)) AS event_id FROM z GROUP BY 1) SELECT hour, event_id FROM h WHERE hour % 5 <> 0")
def sink_hour_archive(spark, sf_dir):
    """A line of JSON for each hour that the archive lacks: the newest state of the hour."""
    z = zoned(spark, sf_dir).groupBy("ep").agg(F.max("event_id").alias("event_id"))
    have = z.select(F.floor(K("ep") / 3600).alias("hour")).where("hour % 5 = 0").distinct()
    hours = sinks.one_line_an_hour(z, have)
    return hours.select("hour", F.from_json("line", "event_id long")["event_id"].alias("event_id"))


@query(f"WITH {QUAKES} SELECT event_id % 4 = 1 AND magnitude < 4 AS removed, count(*) AS n, sum(CASE WHEN event_id % 4 = 1 AND magnitude < 4 THEN event_id - 1 END) AS kept FROM quakes GROUP BY 1")
def sink_audited(spark, sf_dir):
    """Losers leave the catalogue for an audit table that names what was kept."""
    q = quakes(spark, sf_dir)
    losers = q.where("event_id % 4 = 1 and magnitude < 4").select("event_id", (K("event_id") - 1).alias("kept_id"))
    stay, gone = sinks.audited(q, losers, "event_id")
    both = stay.select(F.lit(False).alias("removed"), F.lit(None).cast("long").alias("kept_id")).union(gone.select(F.lit(True), "kept_id"))
    return both.groupBy("removed").agg(F.count("*").alias("n"), F.sum("kept_id").alias("kept"))
