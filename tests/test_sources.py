"""Reading, writing, commands and streams over small files."""

import functools
import gzip
import http.server
import json
import shutil
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from headway.functions import config
from headway.plans import conversion
from headway.sources import catalog, jelly, sinks
from headway.sources import feed as feeds
from headway.streaming.incremental import stream_fresh_pairs, stream_new_rules

FILES = {
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nt1,9:00,9:00,B,10,,1\nt1,8:00,8:00,A,9,0,\nt2,8:30,8:30,A,1\nt2,9:30,9:30,\"C\",2,,\n",
    "trips": "route_id,service_id,trip_id,trip_headsign\nr,s,t1,\"To \"\"B\"\"\"\nr,s,t2\n",
    "routes": "route_id,route_long_name\nr,Line 1\n",
    "stops": "stop_id,stop_name\nA,a\nB,b\nC,c\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,1,1,1,1,1,1,20240101,20240103\n",
}


@pytest.fixture
def place(tmp_path):
    at = tmp_path / "a feed"
    at.mkdir()
    for name, text in FILES.items():
        (at / f"{name}.txt").write_text(text)
    return at


def test_feed_is_read_as_text(spark, place):
    feed = feeds.read_feed(spark, str(place))
    assert feed.calendar_dates.count() == 0
    assert [(r.trip_id, r.trip_headsign) for r in feed.trips.collect()] == [("t1", 'To "B"'), ("t2", "")]
    (place / "stops.txt").unlink()
    with pytest.raises(FileNotFoundError, match="Missing required GTFS file: stops.txt"):
        feeds.read_feed(spark, str(place))


def test_conversion_gives_each_connection_once(spark, place, tmp_path):
    out = conversion.convert(spark, str(place), str(tmp_path / "out"), "CSV")
    lines = Path(out).read_text().splitlines()
    assert out.endswith("connections.csv") and len(lines) == 7 and lines[0].startswith('"departureStop","departureTime"')
    assert '"A","2024-01-01T08:00:00.000Z","B","2024-01-01T09:00:00.000Z","t1","r","To ""B"""' in lines
    again = conversion.convert(spark, str(place), str(tmp_path / "out"), "csv")
    assert len(Path(again).read_text().splitlines()) == 1
    (place / "calendar.txt").write_text(FILES["calendar"].replace("20240103", "20240104"))
    more = conversion.convert(spark, str(place), str(tmp_path / "out"), "jsonld", compressed=True)
    rows = [json.loads(x) for x in gzip.open(more, "rt")]
    assert "@context" in rows[0] and {r["departureTime"][:10] for r in rows[1:]} == {"2024-01-04"} and len(rows) == 3


def test_joining_and_sorting_a_file(spark, place, tmp_path):
    out = conversion.convert(spark, str(place), str(tmp_path / "o"), "jsonld")
    rows, context = conversion.join_and_sort(spark, out)
    times = [r.departureTime for r in rows.collect()]
    assert len(times) == 6 and times == sorted(times) and "@context" in json.loads(context)


@pytest.mark.parametrize(("fmt", "mark"), [("turtle", "@version"), ("n-triples", "VERSION"), ("mongo", "$date"), ("mongold", "_id"), ("json", "startTime")])
def test_formats_are_written(spark, place, tmp_path, fmt, mark):
    text = Path(conversion.convert(spark, str(place), str(tmp_path / "o"), fmt)).read_text()
    assert mark in text and (fmt not in ("turtle", "n-triples") or text.count(mark) == 1)


def test_binary_messages_round_trip(spark, place, tmp_path):
    out = conversion.convert(spark, str(place), str(tmp_path / "o"), "jelly", compressed=True)
    frames = jelly.read_frames(gzip.open(out).read())
    assert len(frames) == 6 and all(len({s for s, *_ in f}) == 1 and 7 <= len(f) <= 10 for f in frames)
    raw = gzip.open(out).read()
    assert raw.count(b"gtfs") >= 2 and raw.startswith(jelly.delimited(jelly.namespaces({"lc": "http://example.org/ns/connections#", "gtfs": "http://vocab.gtfs.org/terms#", "xsd": "http://www.w3.org/2001/XMLSchema#"})))
    assert any(o == "To \"B\"" and d.endswith("#string") for f in frames for _, _, o, d in f if d)


def test_window_and_clean(spark, place, tmp_path):
    out = conversion.window_build(spark, str(place), str(tmp_path / "w"), "2024-01-02", 1)
    assert len(Path(out).read_text().splitlines()) == 2
    feeds.clean_feed(spark, str(place), str(tmp_path / "clean"))
    rows = feeds.read_feed(spark, str(tmp_path / "clean")).stop_times.collect()
    assert [(r.trip_id, r.stop_sequence) for r in rows] == [("t1", "9"), ("t1", "10"), ("t2", "1"), ("t2", "2")]


def test_commands(spark, place, tmp_path, capsys):
    assert conversion.main(["convert", str(place), "-f", "xml", "-o", str(tmp_path)]) == 1
    assert "Unsupported format" in capsys.readouterr().err
    assert conversion.main(["convert", str(place), "-f", "csv", "-o", str(tmp_path / "c"), "--fresh"]) == 0
    assert conversion.main(["window-build", str(place), "--start", "2024-1-1", "-o", str(tmp_path)]) == 1


def test_streams_go_to_stdout(place, tmp_path, capfdbinary):
    for fmt, mark in (("csv", b'"departureStop"'), ("jelly", b"\x0a")):
        for more in ([], ["-c"]):
            assert conversion.main(["convert", str(place), "-f", fmt, "-o", str(tmp_path / f"{fmt}{len(more)}"), "-s", *more]) == 0
            out = capfdbinary.readouterr().out
            assert mark in (gzip.decompress(out) if more else out)
    left = sorted(p.name for p in (tmp_path / "csv0").iterdir())
    assert left == ["connections.csv", "history.parquet"]


def test_feeds_without_optional_columns(spark, place, tmp_path):
    (place / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,9:00,9:00,B,10\nt1,8:00,8:00,A,9\n")
    assert len(Path(conversion.convert(spark, str(place), str(tmp_path / "o"), "csv")).read_text().splitlines()) == 4


def test_windows_of_feeds_at_an_address(spark, place, tmp_path, monkeypatch, capsys):
    (tmp_path / "www").mkdir()
    shutil.make_archive(str(tmp_path / "www/feed"), "zip", place.parent, place.name)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "www")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for name, value in (("FEED", f"http://127.0.0.1:{server.server_port}/feed.zip"), ("START", "2024-01-02"), ("DAYS", "1"), ("FORMAT", "csv"), ("OUTPUT", str(tmp_path / "o"))):
        monkeypatch.setenv(f"HEADWAY_{name}", value)
    assert conversion.main(["window-build"]) == 0
    out = capsys.readouterr().out.strip().splitlines()[-1]
    assert len(Path(out).read_text().splitlines()) == 3 and sorted(p.name for p in (tmp_path / "o").iterdir()) == ["connections.csv", "history.parquet"]
    monkeypatch.setenv("HEADWAY_FEED", f"http://127.0.0.1:{server.server_port}/none.zip")
    assert conversion.main(["window-build"]) == 1
    server.shutdown()


def test_missing_rows_fail_or_are_listed(spark, place, tmp_path):
    (place / "stops.txt").write_text("stop_id,stop_name\nA,a\nB,b\n")
    with pytest.raises(Exception, match="Missing stop: C"):
        conversion.convert(spark, str(place), str(tmp_path / "o"), "csv")
    out = conversion.convert(spark, str(place), str(tmp_path / "o"), "csv", strict=False)
    assert len(Path(out).read_text().splitlines()) == 4
    assert [(r.trip_id, r.missing, r.key) for r in spark.read.parquet(str(tmp_path / "o/dropped.parquet")).collect()] == [("t2", "arrival_stop", "C")]


def test_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"@id":"a","gtfs:trip":"t","speed":3}\r\n\n{broken\n')
    rows, context = feeds.read_linked(spark, str(tmp_path / "x.json"), malformed="drop")
    assert [(r["@id"], r.speed) for r in rows.collect()] == [("a", "3")] and context is None
    with pytest.raises(Exception, match="No JSON object"):
        feeds.read_linked(spark, str(tmp_path / "x.json"))[0].collect()


def test_tables_are_rewritten(spark, place, tmp_path):
    feeds.rewrite_table(spark, str(place / "stops.txt"), str(tmp_path / "stops.txt"), lambda t: t.where("stop_id <> 'B'").withColumn("stop_name", F.upper("stop_name")))
    assert [(r.stop_id, r.stop_name) for r in feeds.read_table(spark, str(tmp_path / "stops.txt")).collect()] == [("A", "A"), ("C", "C")]


def test_configurations_are_set_up_by_asking(spark, tmp_path, capsys):
    feeds_found = [{"id": f"mdb-{i}", "provider": p, "latest_dataset": {"hosted_url": f"https://h.example/{i}.zip"}, "locations": [{"municipality": "Novby", "country_code": "BE"}], "status": "active"} for i, p in ((1, "One"), (2, "Two"))]
    answers = iter(["2", "", "https://a.example/x", "", "", "", "", "y"])
    made = conversion.set_up(spark, "novby", str(tmp_path), lambda _: next(answers), lambda _: feeds_found)
    assert made["_meta"]["feedUrl"] == "https://h.example/2.zip" and (tmp_path / "two-mdb-2.json").exists()
    assert "2. Two (mdb-2, Novby, BE, active)" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no feed 3"):
        conversion.set_up(spark, "novby", str(tmp_path), lambda _: "3", lambda _: feeds_found)
    with pytest.raises(ValueError, match="no schedule feed"):
        catalog.search("nothing", "t", get=lambda url, token: {"results": [{"data_type": "gtfs_rt"}]})


def test_feed_discovery(place, tmp_path):
    assert feeds.find_feed(str(tmp_path)) == str(place)
    with pytest.raises(FileNotFoundError):
        feeds.find_feed(str(_empty(tmp_path)))


def _empty(tmp_path):
    (tmp_path / "empty").mkdir()
    return tmp_path / "empty"


def test_stream_of_feed_versions(spark, tmp_path):
    source = tmp_path / "in"
    schema = "rule_key string, trip_id string, _seq double, _ord bigint, service_dates array<date>"
    got = []

    def version(name, rows):
        df = spark.createDataFrame(rows, "k string, t string, d array<string>").select(
            F.col("k").alias("rule_key"), F.col("t").alias("trip_id"), F.lit(1.0).alias("_seq"), F.lit(1).cast("bigint").alias("_ord"), F.col("d").cast("array<date>").alias("service_dates")
        )
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        stream_new_rules(stream, str(tmp_path / "history"), str(tmp_path / "cp"), lambda b, n: got.append(sorted((r.trip_id, len(r.service_dates)) for r in b.collect()))).awaitTermination()
        return name

    version(1, [("a", "t1", ["2024-01-01", "2024-01-02"]), ("a", "t2", ["2024-01-02", "2024-01-03"])])
    version(2, [("a", "t9", ["2024-01-03", "2024-01-04"])])
    assert got == [[("t1", 2), ("t2", 1)], [("t9", 1)]]
    pairs = spark.readStream.schema(schema).parquet(str(source)).select("rule_key", F.explode("service_dates").alias("service_date"))
    q = stream_fresh_pairs(pairs).writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pairs").count() == 4
    timed = stream_fresh_pairs(pairs.withColumn("at", F.lit("2024-01-01").cast("timestamp")), "at", "1 day")
    timed.writeStream.format("memory").queryName("timed").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("timed").count() == 4


def test_names_and_configurations(spark, tmp_path):
    assert config.slugify("Västra Höga — Łine!") == "vastra-hoga-ine" and config.configuration_file("", "mdb-1") == "agency-mdb-1.json"
    assert config.validate_namespace("https://a.example/x") == "https://a.example/x/"
    for bad in ("urn:x:y", "https://a.example/{x}", "https://a.example/?q", "nothing"):
        with pytest.raises(ValueError):
            config.validate_namespace(bad)
    uris = config.recommended_uris("https://a.example")
    config.validate_templates(uris)
    assert len(set(config.preview_uris(spark, uris).values())) == 4
    feed = {"id": "mdb-77", "source_info": {"producer_url": "https://p.example/f.zip"}, "latest_dataset": {"hosted_url": "https://h.example/f.zip"}}
    path = config.write_configuration(str(tmp_path), "Hill Line", feed, catalog.feed_url(feed), uris)
    assert path.endswith("hill-line-mdb-77.json") and Path(path).stat().st_mode & 0o777 == 0o600
    (tmp_path / "bad-mdb-2.json").write_text("{")
    known = config.read_configurations(str(tmp_path))
    assert config.match_configuration(known, "Hill Line") and not config.match_configuration(known, "other") and not config.match_configuration(known * 2, "hill-line")
    with pytest.raises(ValueError):
        config.parse_day("2024-02-30")
    with pytest.raises(ValueError):
        config.positive_integer("367", "days")
    assert config.normalise_format("N-Triples") == "ntriples" and config.worker_count("0") == 1
    assert catalog.search("mdb-7", "t", get=lambda url, token: {"url": url})[0]["url"].endswith("/gtfs_feeds/mdb-7")
    assert catalog.feed_url({"id": "x", "source_info": {"producer_url": "p", "authentication_type": 1}, "latest_dataset": {"hosted_url": "h"}}) == "h"


def test_helpers():
    assert sinks.strip_version_lines('@version "1"\na\n@version "1"\nb\n', keep_first=True) == '@version "1"\na\nb\n'
    assert jelly.varint(300) == b"\xac\x02"


def test_what_is_written_leaves_no_shuffle_files(spark):
    import time

    from headway.sources.tables import written

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())}
    before = files()
    rows = written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").agg(F.count("*").alias("n")))
    left = lambda: [f for f in files() - before if f.startswith("shuffle_")]
    ends = time.time() + 10
    while left() and time.time() < ends:
        time.sleep(0.2)
    assert not left() and len(rows.collect()) == 7


def test_last_rows_stay_where_they_are_aggregated(spark):
    from headway.operators import service_calendar as cal

    rows = spark.range(100).selectExpr("string(id % 9) AS k", "id AS v", "id AS _ord")
    other = spark.range(9).selectExpr("string(id) AS o").repartition(4, "o").hint("merge")
    joined = cal.last_wins(rows, "k").join(other, F.col("k") == F.col("o"))
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    assert sorted((r.k, r.v) for r in joined.collect()) == [(str(k), max(v for v in range(100) if v % 9 == k)) for k in range(9)]
