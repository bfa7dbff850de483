"""A stored list of points in the order of a Z-curve, so that places near each other share files.

A version of the list is a table of its files with the rectangle and the range
of the curve that each covers. A viewport reads the files whose rectangles it
meets, and Parquet's own statistics skip row groups in them. Changes rewrite the
files in whose ranges they fall; a version is published by one rename.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
FILES = "file string, min_lat double, max_lat double, min_lon double, max_lon double, min_z long, max_z long, rows long"


def z_of(lat: Column, lon: Column) -> Column:
    """The place on the curve: BITS bits of each coordinate, one from each in turn; points without coordinates come first."""

    def cell(x: Column, low: float, width: float) -> Column:
        return F.least(F.greatest(F.floor((x - low) / width * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")

    def spread(x: Column) -> Column:  # bits move apart by halves: 8, 4, 2, then 1
        for shift in (8, 4, 2, 1):
            mask = sum(((1 << shift) - 1) << at for at in range(0, 2 * BITS, 2 * shift))
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    z = F.shiftleft(spread(cell(lat, -90.0, 180.0)), 1).bitwiseOR(spread(cell(lon, -180.0, 360.0)))
    return F.when(lat.isNotNull() & lon.isNotNull(), z).otherwise(F.lit(-1))


class PlacedList:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version that is published; 0 before any."""
        folder, fs = self._file(f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def files(self) -> DataFrame:
        now = self.version()
        return self.spark.read.schema(FILES).parquet(f"{self.path}/versions/{now:08d}") if now else self.spark.createDataFrame([], FILES)

    def _publish(self, files: DataFrame, version: int) -> None:
        made = f"{self.path}/versions/new-{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(made)  # one row a file
        fs = self._file(made)[1]
        if not fs.rename(self._file(made)[0], self._file(f"{self.path}/versions/{version:08d}")[0]):
            raise RuntimeError(f"version {version} is there already")

    def _written(self, points: DataFrame, n_files: int) -> DataFrame:
        """Writes points in order of the curve and gives a row for each file."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        z = z_of(F.col("lat"), F.col("lon"))
        points.withColumn("z", z).repartitionByRange(n_files, "z", "ord").sortWithinPartitions("z", "ord").write.parquet(place)
        rows = self.spark.read.schema(points.withColumn("z", z).schema).parquet(place)
        edges = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon", "z") for f in (F.min, F.max)]
        return rows.groupBy(F.input_file_name().alias("file")).agg(*edges, F.count("*").alias("rows")).select("file", "min_lat", "max_lat", "min_lon", "max_lon", "min_z", "max_z", "rows")

    def write(self, points: DataFrame, n_files: int) -> PlacedList:
        """points (ord, lat, lon and others) as the next version, in about so many files."""
        self._publish(self._written(points, n_files), self.version() + 1)
        return self

    def _read(self, files: list[str]) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/data/*")
        return (self.spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)).drop("z")

    def viewport(self, south: float, north: float, west: float, east: float) -> DataFrame:
        """The points inside, edges included; over the date line if west is beyond east."""
        lons = lambda low, high: (F.col(high) >= west) & (F.col(low) <= east) if west <= east else (F.col(high) >= west) | (F.col(low) <= east)
        met = self.files().where((F.col("max_lat") >= south) & (F.col("min_lat") <= north) & lons("min_lon", "max_lon"))
        found = [r[0] for r in met.select("file").collect()]  # names of the files that are read
        return self._read(found).where(F.col("lat").between(south, north) & lons("lon", "lon"))

    def read(self) -> DataFrame:
        return self._read([r[0] for r in self.files().select("file").collect()])

    def change(self, new: DataFrame, gone: DataFrame, n_files: int = 1) -> int:
        """The next version: without points that gone names (ord, lat, lon), with new ones; the number of files that were rewritten."""
        files = self.files()
        z = z_of(F.col("lat"), F.col("lon"))
        places = new.select(z.alias("z")).union(gone.select(z.alias("z"))).distinct()
        edges = files.select("min_z", "max_z").orderBy("min_z").collect()  # one row a file
        low = F.array(*(F.lit(r.min_z) for r in edges), F.lit(1 << 62))
        # files whose range holds a place, several if they share it; for a place between two ranges the one before
        before = F.greatest(F.size(F.filter(low, lambda m: m <= F.col("z"))), F.lit(1))
        marks = {r[0] for r in places.select(F.get(low, before - 1)).distinct().collect()}  # at most one row a file
        names = [r.file for r in files.where(F.col("min_z").isin(*marks) | F.col("max_z").isin(*marks)).select("file").collect()]
        kept = self._read(names).join(gone.select("ord"), "ord", "left_anti")
        written = self._written(kept.unionByName(new.select(*kept.columns)), max(n_files, len(names)))
        rest = files.where(~F.col("file").isin(*names)) if names else files
        self._publish(rest.unionByName(written), self.version() + 1)
        return len(names)
