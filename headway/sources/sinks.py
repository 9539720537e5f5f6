"""Writing outputs: part files by Spark, and single files joined from them."""

from __future__ import annotations

import gzip
import shutil
import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from headway.functions.uris import Templates
from headway.sources import formats, jelly


def write_parts(fmt: str, connections: DataFrame, path: str, templates: Templates | None = None, timezone: str = "UTC", compression: str = "gzip") -> None:
    """Text part files of a format, without a header, wherever Spark can write."""
    formats.rows_of(fmt, connections, templates, timezone).select("value").write.mode("overwrite").option("compression", compression).text(path)


def file_name(fmt: str, compressed: bool) -> str:
    return f"connections.{formats.EXTENSIONS[fmt]}" + (".gz" if compressed else "")


def write_single(fmt: str, connections: DataFrame, directory: str, templates: Templates | None = None, timezone: str = "UTC", compressed: bool = False) -> str:
    """One local file: header, then the part files in order. Compressed parts are joined as gzip members."""
    target = Path(directory) / file_name(fmt, compressed)
    target.parent.mkdir(parents=True, exist_ok=True)
    head = formats.header(fmt, templates)
    with tempfile.TemporaryDirectory(dir=directory) as work, target.open("wb") as out:
        if fmt == "jelly":
            packer = gzip.open(out, "wb") if compressed else out
            packer.write(jelly.delimited(jelly.namespaces(formats.prefix_names(templates))))
            for row in jelly.to_jelly_rows(formats.quads(connections, templates, timezone)).toLocalIterator():
                packer.write(bytes(row.value))
            if compressed:
                packer.close()
            return str(target)
        write_parts(fmt, connections, f"{work}/parts", templates, timezone)
        if head is not None:
            out.write(gzip.compress(f"{head}\n".encode()) if compressed else f"{head}\n".encode())
        for part in sorted(Path(work, "parts").glob("part-*.gz")):
            with part.open("rb") as f:
                shutil.copyfileobj(f if compressed else gzip.open(f), out)
    return str(target)


def strip_version_lines(text: str, keep_first: bool = False) -> str:
    """RDF message text without repeated version headers, for joining files made elsewhere."""
    out, seen = [], False
    for line in text.splitlines(keepends=True):
        version = line.lstrip().startswith(("@version", 'VERSION "'))
        if version and (seen or not keep_first):
            seen = True
            continue
        seen = seen or version
        out.append(line)
    return "".join(out)


def append_history(pairs: DataFrame, path: str, fresh: bool = False) -> None:
    """Adds given (rule_key, service_date, type) to the history, after the output is written; `fresh` starts it anew.

    A folder per service date: a later run reads the dates it has, not the whole history.
    """
    pairs.repartition("service_date").write.mode("overwrite" if fresh else "append").partitionBy("service_date").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The history at a path, on whatever storage; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
