"""Sources: landed records and responses, JSON and XML documents, raster and pixel tables, CSV; and the sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, keys
from ..operators import joins, order

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "dataset", "record_timestamp_utc", "ingested_at_utc")] + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude")] + [T.StructField(c, T.StringType()) for c in ("geometry_wkt", "crs", "grid_id", "raw_record_ref", "payload")])
#: Members of a response that may hold its records, and members that may hold a record's time, in order.
LISTS = ("layers", "records", "features", "metadata")
TIMES = ("timestamp", "time", "datetime", "date", "acquired", "updated")
PLACEHOLDERS = ("synthetic", "placeholder", "fake_data")


def read_records(spark: SparkSession, root: str, source: str) -> DataFrame:
    """All Parquet files below ``root/source`` with the record schema, source stamped; none if the folder is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("recursiveFileLookup", True).parquet(f"{root}/{source}").withColumn("source", F.lit(source))


def header_names(df: DataFrame) -> DataFrame:
    """Column names stripped, in lower case, blanks as underscores."""
    return df.toDF(*["_".join(c.strip().lower().split()) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return header_names(spark.read.csv(path, header=True))


def resolve(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns by the first of their candidate names that exists, whatever the case; null where none does."""
    have = {c.lower(): c for c in df.columns}
    pick = {name: next((have[c.lower()] for c in candidates if c.lower() in have), None) for name, candidates in wanted.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None)).alias(name) for name, c in pick.items()])


def read_folder(spark: SparkSession, root: str, hints: dict[str, str]) -> dict[str, DataFrame]:
    """CSV and GeoJSON files of a folder, named by hints in their file names; features become rows of properties."""
    out = {}
    for name, hint in hints.items():
        if hint.endswith("json"):
            rows = spark.read.option("multiLine", True).json(f"{root}/{hint}").select(F.explode("features").alias("f"))
            out[name] = rows.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))
        else:
            out[name] = read_csv(spark, f"{root}/{hint}")
    return out


def standardize(responses: DataFrame) -> DataFrame:
    """Records of landed JSON responses: the list under one of ``LISTS``, a bare list, or the object itself.

    The place is the middle of a bbox or the record's own latitude and longitude, the time the first of ``TIMES`` that
    parses.  Responses that are not JSON, null or empty give no row.
    """
    body = F.col("response_payload")
    arrays = [F.from_json(F.get_json_object(body, f"$.{name}"), "array<string>") for name in LISTS]
    bare = F.when(body.rlike(r"^\s*\["), F.from_json(body, "array<string>"))
    single = F.when(body.rlike(r"^\s*\{") & F.expr("try_parse_json(response_payload) is not null"), F.array(body))
    rows = responses.withColumn("payload", F.explode(F.coalesce(*arrays, bare, single)))
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    number = lambda p: get(p).try_cast("double")
    box = F.from_json(F.coalesce(get("bbox"), get("properties.bbox")), "array<double>")
    box = F.when((F.size(box) >= 4) & ~F.exists(box, lambda x: x.isNull()), box)  # all of it or none
    at = lambda i: F.try_element_at(box, F.lit(i))
    time = F.coalesce(*[F.try_to_timestamp(F.coalesce(get(t), get(f"properties.{t}"))) for t in TIMES])
    lat = F.coalesce((at(2) + at(4)) / 2, number("latitude"), number("lat"))
    lon = F.coalesce((at(1) + at(3)) / 2, number("longitude"), number("lon"))
    return rows.select(
        "source", "dataset", time.alias("record_ts"), lat.alias("latitude"), lon.alias("longitude"), geo.bbox_wkt(at(1), at(2), at(3), at(4)).alias("geometry_wkt"),
        F.coalesce(get("crs"), F.lit("EPSG:4326")).alias("crs"), F.coalesce(get("grid_id"), keys.cell_id(lat, lon)).alias("grid_id"), F.col("request_signature").alias("raw_record_ref"), "payload",
    )


def map_layers(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Named layers of map-service capabilities, a row for each: name, title, and west, south, east, north as given."""
    part = lambda p: F.xpath(F.col(xml), F.lit(f"//Layer[Name]/{p}"))
    wanted = {"name": "Name/text()", "title": "Title/text()", "west": "BoundingBox/@minx", "south": "BoundingBox/@miny", "east": "BoundingBox/@maxx", "north": "BoundingBox/@maxy"}
    rows = documents.where(F.col(xml).startswith("<")).select(*[c for c in documents.columns if c != xml], F.explode(F.arrays_zip(*[part(p).alias(n) for n, p in wanted.items()])).alias("l"))
    number = lambda n: F.col(f"l.{n}").try_cast("double").alias(n)
    return rows.select(*[c for c in documents.columns if c != xml], "l.name", "l.title", *[number(n) for n in ("west", "south", "east", "north")])


def metadata_record(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, abstract, keywords, date (publication, else revision, else creation) and box of metadata records."""
    one = lambda p: F.nullif(F.xpath_string(F.col(xml), F.lit(p)), F.lit(""))
    date = F.coalesce(*[one(f"//date[@type='{t}']") for t in ("publication", "revision", "creation")], one("//dateStamp"))
    bound = lambda p: one(f"//{p}").try_cast("double")
    return documents.select(
        "*", one("//title").alias("title"), one("//abstract").alias("abstract"), F.concat_ws(";", F.xpath(F.col(xml), F.lit("//keyword/text()"))).alias("keywords"), date.alias("date"),
        geo.bbox_wkt(bound("west"), bound("south"), bound("east"), bound("north")).alias("geometry_wkt"),
    )


STATS = "struct<data:array<struct<interval:struct<`from`:string>,outputs:struct<index:struct<bands:struct<B0:struct<stats:struct<mean:double,sampleCount:bigint,noDataCount:bigint,percentiles:map<string,double>>>>>>>>>"


def weekly_stats(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each interval of a statistics response: week, mean, median, valid observations."""
    rows = payloads.withColumn("d", F.explode(F.from_json(payload, STATS)["data"])).withColumn("s", F.col("d.outputs.index.bands.B0.stats"))
    return rows.select(*[c for c in payloads.columns if c != payload], keys.week_start(F.to_timestamp("d.interval.from")).alias("week"), F.col("s.mean").alias("mean"), F.try_element_at(F.col("s.percentiles"), F.lit("50.0")).alias("median"), (F.col("s.sampleCount") - F.col("s.noDataCount")).alias("n_valid"))


def filled_count(count: Column, payload: Column) -> Column:
    """A count, else samples less no-data samples from the payload."""
    part = lambda p: F.get_json_object(payload, p).try_cast("bigint")
    return F.coalesce(count, part("$.sampleCount") - part("$.noDataCount"))


def enriched(records: DataFrame) -> DataFrame:
    """Metadata promoted from the payload: title, topic, keywords, geometry and time where the record has none."""
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    box = F.from_json(get("bbox"), "array<double>")
    at = lambda i: F.try_element_at(box, F.lit(i))
    return records.withColumns({
        "title": get("title"), "topic": get("topic"), "keywords": F.concat_ws(";", F.from_json(get("keywords"), "array<string>")),
        "geometry_wkt": F.coalesce("geometry_wkt", geo.bbox_wkt(at(1), at(2), at(3), at(4))), "record_ts": F.coalesce("record_ts", F.try_to_timestamp(get("temporal"))),
    })


def raster_overview(cells: DataFrame) -> DataFrame:
    """Per layer file ``<name>_<code>_<year>.<ext>``: pixels, valid pixels and their distribution; lane and group flags over all layers."""
    code, year = F.regexp_extract("file", r"_([0-9]+)_([0-9]{4})\.", 1), F.regexp_extract("file", r"_([0-9]+)_([0-9]{4})\.", 2).try_cast("int")
    o = cells.groupBy("file", code.alias("code"), year.alias("year")).agg(F.count("*").alias("pixels"), F.count("value").alias("valid"), F.min("value").alias("min"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.round(F.stddev_pop("value"), 6).alias("std"))
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    o = order.beside(o, cells, ["file"], {name: ("value", q) for name, q in shares.items()}).withColumns({name: F.round(name, 6) for name in shares})
    cuts = o.agg(F.percentile("mean", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias("c"))  # a row for each layer
    group = F.when(F.col("mean") >= F.col("c")[1], "high").when(F.col("mean") <= F.col("c")[0], "low").when(F.col("mean").isNotNull(), "middle")
    return o.crossJoin(F.broadcast(cuts)).withColumns({"log_mean": F.round(F.log1p("mean"), 6), "lane": F.coalesce(F.col("mean") >= F.col("c")[2], F.lit(False)), "group": group}).drop("c")


def raster_at_cells(raster: DataFrame, cells: DataFrame, *, west: float, north: float, size: float) -> DataFrame:
    """Sum over a year's layers of the raster value at each cell's centre; null only if no layer has a value there."""
    place = cells.select("cell", F.floor((F.col("lon") - west) / size).cast("long").alias("x"), F.floor((north - F.col("lat")) / size).cast("long").alias("y"))
    return place.join(raster, ["x", "y"]).groupBy("cell", "year").agg(F.sum("value").alias("traffic"))


def optical_indices(pixels: DataFrame, keep: list[int], *, land_only: bool = False) -> DataFrame:
    """Composite of pixel observations by cell and week: water, turbidity and vegetation indices.

    Bands are scaled by 1/10000; only the classes in ``keep`` count, with ``land_only`` only where the water index is
    not positive; each pixel is averaged over the week first.
    """
    b = {c: F.col(c) / 10000.0 for c in ("b3", "b4", "b5", "b8", "b11")}
    ratio = lambda x, y: keys.safe_ratio(b[x] - b[y], b[x] + b[y])
    made = {"ndwi": ratio("b3", "b8"), "ndti": ratio("b4", "b3"), "ndci": ratio("b5", "b4"), "ndvi": ratio("b8", "b4"), "fai": b["b8"] - (b["b4"] + (b["b11"] - b["b4"]) * (842 - 665) / (1610 - 665)), "b11s": b["b11"]}
    p = pixels.where(F.col("scl").isin(keep)).withColumns(made)
    p = p.where("ndwi <= 0") if land_only else p
    weekly = p.groupBy("cell", "week", "pixel").agg(*[F.avg(c).alias(c) for c in made])
    stats = [f(c) for c in made for f in (lambda c: F.round(F.avg(c), 6).alias(f"{c}_mean"), lambda c: F.round(F.stddev_pop(c), 6).alias(f"{c}_std"), lambda c: F.round(F.percentile(c, F.lit(0.5)), 6).alias(f"{c}_median"))]
    return weekly.groupBy("cell", "week").agg(*stats)


def dark_surface(pixels: DataFrame) -> DataFrame:
    """Share and number of radar-dark pixels by cell and week.

    Weekly medians by pixel; dark is VH below the week's p20 and, where both bands are there, VV - VH at its p80 or more.
    """
    half = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    m = pixels.groupBy("cell", "week", "pixel").agg(half("vv"), half("vh"))
    cut = order.quantiles(m, ["week"], {"p20": ("vh", 0.2), "p80": (F.col("vv") - F.col("vh"), 0.8)})
    dark = (F.col("vh") < F.col("p20")) & F.coalesce(F.col("vv") - F.col("vh") >= F.col("p80"), F.lit(True))
    d = m.join(cut, "week").where("vh is not null").withColumn("dark", dark.cast("long"))
    return d.groupBy("cell", "week").agg(F.round(F.avg("dark"), 6).alias("probability"), F.sum("dark").alias("count"))


def two_level_mean(pixels: DataFrame, value: str) -> DataFrame:
    """Mean of each pixel in the week, then mean and deviation over a cell's pixels."""
    p = pixels.groupBy("cell", "week", "pixel").agg(F.avg(value).alias("m"))
    return p.groupBy("cell", "week").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"))


def extraction_coverage(panel: DataFrame, value: str) -> DataFrame:
    """Expected weeks, valid weeks, coverage in percent and missing weeks of each cell."""
    return panel.groupBy("cell").agg(F.count("*").alias("expected"), F.count(value).alias("valid"), F.round(100.0 * F.count(value) / F.count("*"), 6).alias("percent"), F.sum(F.col(value).isNull().cast("long")).alias("missing"))


def optional_layer(layer: DataFrame, means: dict[str, list[str]], sums: dict[str, list[str]], clip: tuple[str, ...] = ()) -> DataFrame:
    """A layer under one of several column names, once for each key: means, sums, some held to [0, 1]."""
    r = resolve(layer, {"cell": ["grid_cell_id", "cell"], "week": ["week_start_utc", "week"], **means, **sums})
    value = lambda c: keys.clip(F.col(c).cast("double"), 0, 1) if c in clip else F.col(c).cast("double")
    return r.dropna(subset=["cell", "week"]).groupBy("cell", "week").agg(*[F.round(F.avg(value(c)), 9).alias(c) for c in means], *[F.sum(value(c)).alias(c) for c in sums])


def normalized_wind(wind: DataFrame) -> DataFrame:
    """u, v and speed under their aliases, speed from the parts where missing, directions to and from."""
    w = resolve(wind, {"cell": ["cell", "grid_cell_id"], "week": ["week"], "u": ["u", "wind_u", "u10"], "v": ["v", "wind_v", "v10"], "speed": ["speed", "ws"]})
    to = F.pmod(F.degrees(F.atan2("u", "v")) + 360, F.lit(360.0))
    return w.withColumns({"speed": F.coalesce(F.col("speed").cast("double"), F.hypot("u", "v")), "to_deg": to, "from_deg": F.pmod(to + 180, F.lit(360.0))})


def weekly_wind(hourly: DataFrame, least: int = 24) -> DataFrame:
    """Weekly mean vectors from hourly speed and direction; clusters with fewer than ``least`` hours are left out."""
    enough = hourly.groupBy("cluster").count().where(F.col("count") >= least).select("cluster")
    u, v = -F.col("ws") * F.sin(F.radians("wd")), -F.col("ws") * F.cos(F.radians("wd"))
    g = hourly.join(enough, "cluster", "left_semi").groupBy("cluster", keys.week_start(F.col("time")).alias("week")).agg(F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg("ws").alias("speed"))
    return g.withColumn("to_deg", F.pmod(F.degrees(F.atan2("u", "v")) + 360, F.lit(360.0)))


def placeholder_scan(df: DataFrame, text: str) -> DataFrame:
    """Rows that hold placeholder tokens, with the tokens."""
    hit = F.filter(F.array(*[F.when(F.lower(text).contains(t), F.lit(t)) for t in PLACEHOLDERS]), lambda t: t.isNotNull())
    return df.withColumn("tokens", hit).where(F.size("tokens") > 0)


def complete_weeks(extract: DataFrame, cells: DataFrame, signals: list[str]) -> DataFrame:
    """Weeks of a partial extract that need not run again: all cells there and some signal with a value."""
    n = cells.agg(F.count_distinct("cell").alias("_n"))
    some = F.bool_or(reduce(lambda a, b: a | b, [F.coalesce(F.col(s) > 0, F.lit(False)) for s in signals]))
    return extract.groupBy("week").agg(F.count_distinct("cell").alias("_c"), some.alias("_s")).crossJoin(F.broadcast(n)).where("_c = _n and _s").select("week")


def write_once(df: DataFrame, path: str, key: str = "request_signature", by: tuple[str, ...] = ("source", "dataset")) -> None:
    """Append the rows whose key is not there yet, partitioned; a second run adds nothing."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = df.dropDuplicates([key])
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").partitionBy(*by).parquet(path)


def melt_report(df: DataFrame, name: str, like: str | None = None) -> DataFrame:
    """A report as (source, row, column, value) text cells, for columns whose name matches."""
    columns = [c for c in df.columns if like is None or re.search(like, c)]
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).withColumn("row", F.monotonically_increasing_id())
    return rows.unpivot(["row"], columns, "column", "value").withColumn("source", F.lit(name))


def merge_latest(records: DataFrame) -> DataFrame:
    """The newest ingest of each record: by dataset and catalogue id, else grid id, else reference."""
    key = F.coalesce(F.get_json_object("payload", "$.record_id"), F.col("grid_id"), F.col("raw_record_ref"))
    return joins.latest(records.withColumn("_key", key), ["dataset", "_key"], [F.col("ingested_at_utc").desc_nulls_last(), F.col("raw_record_ref")]).drop("_key")
