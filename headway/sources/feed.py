"""Reading feeds: CSV tables as text columns, NDJSON, discovery, download and unpacking."""

from __future__ import annotations

import shutil
import urllib.request
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("stop_times", "trips", "routes", "stops")
OPTIONAL = {
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
}
#: How stores keep a dimension that is asked to stay: in memory or on disk.
STORES = {"MemStore": "MEMORY_AND_DISK", "LevelStore": "DISK_ONLY"}
LINKED_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("@id", "@type", "departureStop", "arrivalStop", "departureTime", "arrivalTime", "gtfs:trip", "gtfs:route", "direction", "gtfs:pickupType", "gtfs:dropOffType", "@context")
])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table by its header, all columns text, empty cells as '', rows too short filled up with ''.

    Cells beyond the header are dropped. `_ord` follows the order within a file.
    """
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="PERMISSIVE", enforceSchema=True).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return df.toDF(*names).na.fill("").withColumn("_ord", F.monotonically_increasing_id())


def require_files(directory: str) -> None:
    """Fails unless all required tables of a local feed are there."""
    for name in REQUIRED:
        if not (Path(directory) / f"{name}.txt").exists():
            raise FileNotFoundError(f"Missing required GTFS file: {name}.txt")


@dataclass(frozen=True)
class Feed:
    """The tables of a feed, all lazy."""

    stop_times: DataFrame
    trips: DataFrame
    routes: DataFrame
    stops: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame

    def stored(self, store: str) -> Feed:
        """The feed with its dimension tables kept as the store says."""
        level = getattr(StorageLevel, STORES[store])
        return replace(self, trips=self.trips.persist(level), routes=self.routes.persist(level), stops=self.stops.persist(level))

    def released(self) -> None:
        for table in (self.trips, self.routes, self.stops):
            table.unpersist()


def read_feed(spark: SparkSession, directory: str) -> Feed:
    """A feed directory on this machine; missing calendars are empty tables."""
    require_files(directory)
    tables = {name: read_table(spark, str(Path(directory) / f"{name}.txt")) for name in REQUIRED}
    for name, columns in OPTIONAL.items():
        path = Path(directory) / f"{name}.txt"
        schema = ", ".join(f"{c} string" for c in columns) + ", _ord bigint"
        tables[name] = read_table(spark, str(path)) if path.exists() else spark.createDataFrame([], schema)
    return Feed(**tables)


def clean_feed(spark: SparkSession, directory: str, target: str) -> None:
    """Writes normalised copies of a feed's tables to `target`; stop times sorted by trip and sequence. The source stays as it is.

    Each table is a folder of part files named like the file, and `read_feed` reads it back.
    """
    require_files(directory)
    for name in (*REQUIRED, *OPTIONAL):
        source = Path(directory) / f"{name}.txt"
        if source.exists():
            df = read_table(spark, str(source))
            if name == "stop_times":
                df = df.orderBy("trip_id", F.col("stop_sequence").try_cast("double"), "_ord")
            df.drop("_ord").write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(str(Path(target) / f"{name}.txt"))


def read_linked(spark: SparkSession, path: str, malformed: str = "fail") -> tuple[DataFrame, str | None]:
    """Linked connections of an NDJSON file, texts as they stand, and its first context line.

    Blank lines are skipped, line ends may be CRLF, the last line may be open. Further
    context lines stay as rows. Properties beyond the known ones are kept, numbers as
    text. A line that is no JSON object fails the job when it is read, or is left out
    with `malformed="drop"`. The file is read once here, for its properties and context.
    """
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\r$", "")) != "").withColumn("_ord", F.monotonically_increasing_id())
    seen = spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).schema
    known = {f.name for f in LINKED_SCHEMA.fields}
    extra = [f for f in seen.fields if f.name not in known | {"_corrupt", "_ord"}]
    schema = T.StructType([*LINKED_SCHEMA.fields, *extra, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("_ord", "value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    if malformed == "drop":
        parsed = parsed.where(~broken)
    else:
        checked = F.when(broken, F.raise_error(F.concat(F.lit("No JSON object: "), F.col("value"))).cast("bigint")).otherwise(F.col("_ord"))
        parsed = parsed.withColumn("_ord", checked)
    contexts = parsed.where(F.col("r.@context").isNotNull()).orderBy("_ord").select("_ord", "value").head(1)
    rows = parsed if not contexts else parsed.where(F.col("_ord") != contexts[0]._ord)
    return rows.select("r.*", "_ord").drop("@context", "_corrupt"), contexts[0].value if contexts else None


def download(url: str, target: str) -> str:
    """Fetches an archive, following redirects; answers other than 2xx raise."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "headway"})) as answer, Path(target).open("wb") as out:  # noqa: S310
        if not 200 <= answer.status < 300:
            raise OSError(f"Download failed with {answer.status}: {url}")
        shutil.copyfileobj(answer, out)
    return target


def unpack(archive: str, target: str) -> str:
    with zipfile.ZipFile(archive) as z:
        z.extractall(target)
    return find_feed(target)


def find_feed(directory: str) -> str:
    """The directory itself, or its first subdirectory, that has stop_times.txt."""
    for place in (Path(directory), *sorted(p for p in Path(directory).iterdir() if p.is_dir())):
        if (place / "stop_times.txt").exists():
            return str(place)
    raise FileNotFoundError(f"No stop_times.txt in {directory}")


def rewrite_table(spark: SparkSession, path: str, target: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Writes the CSV table at `path`, as `transform` leaves it, to `target`: rows filtered or changed by the DataFrame API."""
    transform(read_table(spark, path)).drop("_ord").write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(target)
