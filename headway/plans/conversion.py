"""A feed to connections: the whole plan, and its commands."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import re
import shutil
import signal
import sys
import tempfile
import threading
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from headway.functions import config
from headway.functions.uris import Templates
from headway.operators import connections as cx
from headway.operators import linking, rules
from headway.operators import service_calendar as cal
from headway.sources import feed as feeds
from headway.sources import catalog, sinks
from headway.sources.tables import checkpointed


def feed_rules(feed: feeds.Feed, history: DataFrame | None = None, strict: bool = False, bounds: tuple[str, str] | None = None) -> DataFrame:
    """New rules of a feed; `bounds` restrict its calendar (yyyyMMdd) before any date is expanded."""
    calendar, dates = feed.calendar, feed.calendar_dates
    if bounds:
        calendar, dates = cal.constrain_calendar(calendar, *bounds), cal.constrain_dates(dates, *bounds)
    found = rules.rules(feed.stop_times, feed.stops, feed.trips, feed.routes, cal.service_dates(calendar, dates), strict)
    return rules.new_rules(checkpointed(found), history)


def convert(spark: SparkSession, source: str, target: str, fmt: str = "json", base_uris: dict | None = None, compressed: bool = False, fresh: bool = False,
            timezone: str = "UTC", workers: int | None = None, strict: bool = True, bounds: tuple[str, str] | None = None, store: str = "MemStore") -> str:
    """Converts a feed to one file in `target` and returns its name. What earlier runs gave is left out, unless `fresh`.

    With `strict` a missing dimension row or an unusable time fails the conversion; else
    such rules are left out, and listed in `dropped.parquet`. `target` must be a folder
    that all executors see. Rules are written once to the checkpoint folder; output and
    history come from there, and nothing else stays behind.
    """
    if store not in feeds.STORES:
        raise ValueError(f"Unsupported store: {store}")
    fmt = config.normalise_format(fmt)
    history_path = f"{target}/history.parquet"
    known = None if fresh else sinks.read_history(spark, history_path)
    feed = feeds.read_feed(spark, source).stored(store)
    try:
        new = feed_rules(feed, known, strict, bounds)
        if workers is not None:
            new = new.repartition(config.worker_count(workers), "trip_id")
        new = checkpointed(new)
        out = sinks.write_single(fmt, cx.connections(new, timezone, strict), target, Templates.of(base_uris), timezone, compressed)
        if not strict:
            rules.dropped_pairs(feed.stop_times, feed.stops, feed.trips, feed.routes).write.mode("overwrite").parquet(f"{target}/dropped.parquet")
        sinks.append_history(rules.history_of(new), history_path, fresh)
    finally:
        feed.released()
    return out


def join_and_sort(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    rows, context = feeds.read_linked(spark, path)
    return linking.join_and_sort(rows), context


def window_build(spark: SparkSession, source: str, target: str, start: str | None = None, days: int | str = 7, timezone: str = "UTC", **options) -> str:
    """A conversion of a rolling window of days, from today in the feed's zone unless a start is given."""
    first = config.parse_day(start or config.today_in(timezone))
    last = config.add_days(first, config.positive_integer(days, "days") - 1)
    return convert(spark, source, target, timezone=timezone, bounds=(config.compact(first), config.compact(last)), fresh=True, **options)


def set_up(spark: SparkSession, query: str, directory: str, ask: Callable[[str], str] = input, search: Callable[[str], list[dict]] | None = None) -> dict:
    """Asks for a feed of the catalogue and for the templates of its URIs, shows an example, and saves the configuration once it is agreed to."""
    found = (search or (lambda q: catalog.search(q, catalog.access_token())))(query)
    for i, feed in enumerate(found, 1):
        print(f"{i}. {config.feed_label(feed)}")
    choice = ask("Number of the feed: ") if len(found) > 1 else "1"
    if not choice.isdigit() or not 1 <= int(choice) <= len(found):
        raise ValueError(f"There is no feed {choice}")
    feed = found[int(choice) - 1]
    url = catalog.feed_url(feed, ask("Address of the archive (empty: as in the catalogue): ").strip() or None)
    uris = config.recommended_uris(config.validate_namespace(ask("Namespace of the URIs: ").strip()))
    for name in ("stop", "route", "trip", "connection"):
        uris[name] = ask(f"Template {name} (empty: {uris[name]}): ").strip() or uris[name]
    config.validate_templates(uris)
    for name, uri in config.preview_uris(spark, uris).items():
        print(f"{name}: {uri}")
    if ask("Save and build? (y/n) ").strip().lower() not in ("y", "yes"):
        raise ValueError("Nothing was saved")
    agency = feed.get("provider") or feed.get("feed_name") or "agency"
    return json.loads(Path(config.write_configuration(directory, agency, feed, url, uris)).read_text())


def _setting(name: str, default: str | None = None) -> str | None:
    """A default from the environment: HEADWAY_ and the option's name."""
    return os.environ.get(f"HEADWAY_{name}", default)


@contextlib.contextmanager
def fetched(place: str, output: str) -> Iterator[str]:
    """The folder of a feed; one that is at an address is unpacked below the output folder, which executors see, and removed afterwards."""
    if not re.match(r"https?://", place):
        yield place
        return
    Path(output).mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=output) as work:
        yield feeds.unpack(feeds.download(place, f"{work}/feed.zip"), f"{work}/feed")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="headway")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-f", "--format", default=_setting("FORMAT", "json"))
    common.add_argument("-b", "--base-uris")
    common.add_argument("-o", "--output", default=_setting("OUTPUT", "."))
    common.add_argument("-c", "--compressed", action="store_true", default=_setting("COMPRESSED", "") in ("1", "true"))
    common.add_argument("--workers", type=int, default=_setting("WORKERS"))
    common.add_argument("--timezone", default=_setting("TIMEZONE", "UTC"))
    p = commands.add_parser("convert", parents=[common])
    p.add_argument("path")
    p.add_argument("-s", "--stream", action="store_true")
    p.add_argument("-S", "--store", default="MemStore")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--skip-missing", action="store_true")
    p = commands.add_parser("clean")
    p.add_argument("path")
    p.add_argument("target")
    p = commands.add_parser("join-and-sort")
    p.add_argument("file")
    p = commands.add_parser("window-build", parents=[common])
    p.add_argument("path", nargs="?", default=_setting("FEED"), help="a feed's folder, or the address of its archive")
    p.add_argument("--start", default=_setting("START"))
    p.add_argument("--days", default=_setting("DAYS", "7"))
    p = commands.add_parser("build", parents=[common])
    p.add_argument("query")
    p.add_argument("--config-dir", default="config")
    a = parser.parse_args(argv)
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, lambda *_: sys.exit(143))  # so that temporary folders are removed
    try:
        if hasattr(a, "format"):
            a.format = config.normalise_format(a.format)
        spark = SparkSession.builder.appName("headway").getOrCreate()
        uris = json.loads(Path(a.base_uris).read_text()) if getattr(a, "base_uris", None) else None
        if a.command == "convert":
            name = convert(spark, a.path, a.output, a.format, uris, a.compressed, a.fresh, a.timezone, a.workers, not a.skip_missing, store=a.store)
            if a.stream:
                with Path(name).open("rb") as f:
                    shutil.copyfileobj(f, sys.stdout.buffer)
                sys.stdout.flush()
            else:
                print(name)
        elif a.command == "clean":
            feeds.clean_feed(spark, a.path, a.target)
        elif a.command == "join-and-sort":
            from pyspark.sql import functions as F

            rows, context = join_and_sort(spark, a.file)
            if context:
                print(context)
            for row in rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).toLocalIterator():
                print(row.value)
        elif a.command == "window-build":
            if not a.path:
                raise ValueError("No feed is named")
            with fetched(a.path, a.output) as place:
                print(window_build(spark, place, a.output, a.start, a.days, a.timezone, fmt=a.format, base_uris=uris, compressed=a.compressed, workers=a.workers))
        else:
            hit = config.match_configuration(config.read_configurations(a.config_dir), a.query)
            settings = hit["config"] if hit else set_up(spark, a.query, a.config_dir)
            with fetched(settings["_meta"]["feedUrl"], a.output) as place:
                print(convert(spark, place, a.output, a.format, settings, a.compressed, True, a.timezone, a.workers))
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
