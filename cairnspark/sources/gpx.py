"""Reading and writing GPX waypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.functions.scalars import escape_xml, utc_time

WPT = "wpt array<struct<_lat:string,_lon:string,ele:string,name:string,time:string,desc:string>>"
CREATOR = "cairnspark"


def read_gpx(spark: SparkSession, path: str, recursive: bool = True, exclude: str | None = None, source_rank: int = 0, glob: str = "*.[gG][pP][xX]") -> DataFrame:
    """The waypoints of all files that fit glob: path, pos, name, lat, lon, ele, time, desc.

    A file that does not parse, or has a number that does not, gives no rows.
    Missing numbers are 0, other missing fields empty.
    """
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    files = files.select("value", F.col("_metadata.file_path").alias("path"))
    if exclude:
        whole = exclude if ":" in exclude else f"file://{exclude}"
        files = files.where(F.regexp_replace("path", "^file:/+", "file:///") != F.regexp_replace(F.lit(whole), "^file:/+", "file:///"))
    return parse_gpx(files, source_rank)


def parse_gpx(files: DataFrame, source_rank: int = 0) -> DataFrame:
    """The waypoints of files (path, value), as read_gpx() gives them."""
    closed = F.col("value").rlike(r"</(?:[\w.-]+:)?gpx\s*>\s*$")
    bare = F.regexp_replace("value", r"(</?)[\w.-]+:(gpx|wpt|ele|name|time|desc)(?=[\s/>])", "$1$2")  # prefixes tell nothing here
    parsed = files.where(closed).select("path", F.from_xml(bare, WPT).alias("x"))
    rows = parsed.select("path", F.posexplode("x.wpt").alias("pos", "w"))
    number = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")).try_cast("double")
    text = lambda c: F.coalesce(F.col(f"w.{c}"), F.lit(""))
    out = rows.select(F.lit(source_rank).alias("source_rank"), "path", "pos", text("name").alias("name"), number(F.col("w._lat")).alias("lat"), number(F.col("w._lon")).alias("lon"), number(F.col("w.ele")).alias("ele"), utc_time(text("time")).alias("time"), text("desc").alias("desc"))
    bad = F.max((F.col("lat").isNull() | F.col("lon").isNull() | F.col("ele").isNull()).cast("int")).over(Window.partitionBy("path"))
    return out.withColumn("bad", bad).where("bad = 0").drop("bad").withColumn("bookmark", F.lit(source_rank == 0))


def rebuilt(bookmarks: DataFrame, others: DataFrame) -> DataFrame:
    """Bookmarks and all other files, the first of each rounded key: by source, path by its parts, then place."""
    from cairnspark.operators.identity import first_of_each

    rows = bookmarks.unionByName(others).withColumn("parts", F.split("path", "/"))
    return first_of_each(rows, "source_rank", "parts", "pos").drop("parts")


def waypoint_xml(points: DataFrame) -> DataFrame:
    """Each point as a wpt element with 6 decimals; empty time, name and desc are left out, as is elevation."""
    part = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"<{c}>"), escape_xml(F.col(c)), F.lit(f"</{c}>"))).otherwise("")
    open_ = F.format_string('<wpt lat="%.6f" lon="%.6f">', F.col("lat"), F.col("lon"))
    return points.select("*", F.concat(open_, part("time"), part("name"), part("desc"), F.lit("</wpt>")).alias("xml"))


def write_gpx(points: DataFrame, path: str) -> None:
    """Writes GPX 1.1 files named .gpx, one for each partition, without the points that are marked deleted.

    The committer publishes the files together; they take their names after that.
    """
    spark = points.sparkSession
    rows = points.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in points.columns else points
    cols = [F.format_string("%.6f", F.col(c)).alias(f"_{c}") for c in ("lat", "lon")]
    cols += [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("time", "name", "desc") if c in points.columns]
    rows.select(*cols).write.format("xml").option("rootTag", f'gpx version="1.1" creator="{CREATOR}" xmlns="http://www.topografix.com/GPX/1/1"').option("rowTag", "wpt").mode("overwrite").save(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.endswith(".xml"):
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name[:-4]}.gpx"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """z, x, y, bytes and mtime of stored tile files under path, whose names are z/x/y.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", k).try_cast("int")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")).where("z is not null")


#: The points of a list that is started without a file.
DEFAULTS = [
    ("New York City", 40.7128, -74.0060),
    ("London", 51.5074, -0.1278),
    ("Paris", 48.8566, 2.3522),
    ("Tokyo", 35.6762, 139.6503),
    ("Brasília", -15.7975, -47.8919),
    ("Sydney", -33.8688, 151.2093),
    ("Ulaanbaatar", 47.8864, 106.9057),
    ("Moscow", 55.7558, 37.6176),
]


def default_points(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon"), F.lit(True).alias("bookmark")) for k, (n, a, o) in enumerate(DEFAULTS))))
    return spark.range(1).select(rows.alias("r")).select("r.*")
