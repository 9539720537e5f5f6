"""The transit operators, against sequential Python and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from headway.functions import uris
from headway.operators import connections as cx
from headway.operators import linking, rules
from headway.operators import service_calendar as cal
from headway.sources import formats

K = linking.ORDER


def compare_key(r):
    return tuple(r.get(k) or "" for k in K)


def sequential(rows):
    """The whole second pass, one row at a time."""
    rows = sorted((dict(r) for r in rows), key=compare_key, reverse=True)  # a stable sort keeps the input order of ties
    last, joined, out, prev = {}, {}, [], None
    na = "gtfs:NotAvailable"

    def emit(c):
        for t in c.get("j", []):
            joined[t] = c["gtfs:trip"]
        nxt = last.get(c["gtfs:trip"])
        ids = None
        if nxt:
            ids = [nxt[0]]
            if c.get("s") and not nxt[1]:
                ids += [last[t][0] for t in c["s"] if t in last]
        elif joined.get(c["gtfs:trip"]) in last:
            ids = [last[joined[c["gtfs:trip"]]][0]]
        last[c["gtfs:trip"]] = (c["@id"], c.get("s"))
        out.append((c["@id"], c["gtfs:trip"], ids))

    for c in rows:
        if prev is not None and all(c.get(k) == prev.get(k) for k in K[:5]):
            host = None
            for field, name in (("gtfs:pickupType", "j"), ("gtfs:dropOffType", "s")):
                a, b = c.get(field) == na, prev.get(field) == na
                if a != b:
                    host, other = (prev, c) if a else (c, prev)
                    host.setdefault(name, []).append(other["gtfs:trip"])
                    break
            if host is not None:
                prev = host
                continue
        if prev is not None:
            emit(prev)
        prev = c
    if prev is not None:
        emit(prev)
    return out


SCHEMA = "`@id` string, departureStop string, arrivalStop string, departureTime string, arrivalTime string, `gtfs:trip` string, `gtfs:route` string, `gtfs:pickupType` string, `gtfs:dropOffType` string, _ord bigint"


@pytest.mark.parametrize("seed", range(4))
def test_linking_is_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(220):
        t = rng.randrange(5)
        rows.append({
            "@id": f"c{i:03d}", "departureStop": rng.choice("AB"), "arrivalStop": "C", "departureTime": f"0{t}", "arrivalTime": f"0{t + 1}", "gtfs:trip": f"t{rng.randrange(30)}", "gtfs:route": rng.choice("rs"),
            "gtfs:pickupType": rng.choice([None, "gtfs:NotAvailable", "gtfs:Regular"]), "gtfs:dropOffType": rng.choice([None, "gtfs:NotAvailable"]), "_ord": i,
        })
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = [(r["@id"], r["gtfs:trip"], r.nextConnection) for r in linking.join_and_sort(df).collect()]
    expected = sequential(rows)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert [g[0] for g in got] == [x["@id"] for x in sorted((r for r in rows if r["@id"] in {g[0] for g in got}), key=compare_key)]


def calendar_rows(spark, rows):
    return spark.createDataFrame(rows, "service_id string, " + ", ".join(f"{d} string" for d in cal.WEEKDAYS) + ", start_date string, end_date string, _ord bigint")


def test_service_dates(spark):
    c = calendar_rows(spark, [
        ("a", *"1111111", "20240101", "20240103", 1), ("back", *"1111111", "20240103", "20240101", 1), ("twice", *"1111111", "20240101", "20240102", 1), ("twice", *"1111111", "20240105", "20240105", 2),
        ("bad", *"1111111", "x", "20240102", 1), ("", *"1111111", "20240101", "20240102", 1), (None, *"1111111", "20240101", "20240102", 1), ("null", None, None, None, None, None, None, None, "20240101", "20240107", 1),
    ])
    e = spark.createDataFrame([("a", "20240102", "2"), ("a", "20240102", "1"), ("a", "20240101", "2"), ("a", "20240109", "3"), ("twice", "20240105", "2"), ("only", "20240110", "1"), ("only", "20240110", "2"), (None, "20240110", "1")], "service_id string, date string, exception_type string")
    got = {r.service_id: [d.day for d in r.service_dates] for r in cal.service_dates(c, e).collect()}
    assert got == {"a": [2, 3], "back": [3, 2, 1], "twice": [5], "bad": [], "null": [], "only": [10]}


def test_calendar_is_clamped(spark):
    c = calendar_rows(spark, [("old", *"1111111", "20240101", "20240131", 1), ("active", *"1111111", "20240101", "20241231", 2)])
    assert [(r.service_id, r.start_date, r.end_date) for r in cal.constrain_calendar(c, "20240205", "20240211").collect()] == [("active", "20240205", "20240211")]


def feed(spark, times):
    st = spark.createDataFrame([(*t, i) for i, t in enumerate(times)], "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string, pickup_type string, drop_off_type string, _ord bigint")
    stops = spark.createDataFrame([(s, "", "far " + s if s == "C" else "") for s in "ABCD"], "stop_id string, stop_code string, stop_headsign string")
    trips = spark.createDataFrame([("t1", "r", "s", "Head", "", "mine"), ("t2", "r", "s", "", "", "x"), ("t2", "r", "s", "", "", "last")], "trip_id string, route_id string, service_id string, trip_headsign string, trip_short_name string, extra string")
    routes = spark.createDataFrame([("r", "Long  Name")], "route_id string, route_long_name string")
    c = calendar_rows(spark, [("s", *"1111111", "20240330", "20240331", 1)])
    e = spark.createDataFrame([], "service_id string, date string, exception_type string")
    return st, stops, trips, routes, cal.service_dates(c, e)


def test_rules_and_connections(spark):
    times = [("t1", "8:00:00", "8:00:00", "A", "1", "0", "0"), ("t1", "25:10", "25:11", "C", "3", "", "1"), ("t1", "", "", "B", "2", "1", ""), ("t2", "8:00:00", "8:00:00", "A", "10", "0", "0"), ("t2", "9:00", "", "B", "9", "", "")]
    r = rules.rules(*feed(spark, times))
    got = {(x.trip_id, x.departure_stop.stop_id, x.arrival_stop.stop_id): x for x in r.collect()}
    assert set(got) == {("t1", "B", "C"), ("t2", "B", "A")}  # the pair into the blank stop is dropped, the one out of it stays
    assert got["t1", "B", "C"].rule_key == "LongName//B/C/8:00:00//25:10/1/1" and got["t1", "B", "C"].headsign == "far C" and got["t2", "B", "A"].headsign == "Long  Name"
    rows = {(x.trip_id, str(x.service_date)): x for x in cx.connections(r, "Europe/Brussels").withColumns({"a": cx.iso(F.col("arrivalTime")), "s": cx.iso(F.col("trip.startTime"))}).collect()}
    assert rows["t1", "2024-03-31"].a == "2024-04-01T00:10:00.000Z" and rows["t1", "2024-03-31"].s == "2024-03-31T07:00:00.000Z" and rows["t1", "2024-03-31"].departureTime is None
    with pytest.raises(Exception, match="Invalid time"):
        cx.connections(r, strict=True).collect()


def test_missing_dimension_fails_when_strict(spark):
    parts = feed(spark, [("t1", "8:00", "8:00", "A", "1", "", ""), ("t1", "9:00", "9:00", "Z", "2", "", "")])
    assert rules.rules(*parts).count() == 0
    with pytest.raises(Exception, match="Missing stop: Z"):
        rules.rules(*parts, strict=True).collect()


def test_equal_content_is_given_once_and_history_holds(spark):
    pair = [("8:00:00", "8:00:00", "A", "1", "0", "0"), ("9:00", "9:00", "B", "2", "", "")]
    r = rules.rules(*feed(spark, [(t, *p) for t in ("t2", "t1") for p in pair]))
    new = rules.new_rules(r)
    assert [(x.trip_id, len(x.service_dates)) for x in new.collect()] == [("t1", 2)]
    history = rules.history_of(new)
    assert rules.new_rules(r, history).count() == 0
    assert [str(x.service_date) for x in rules.fresh_pairs(r, history.where("service_date < '2024-03-31'")).collect()] == ["2024-03-31"]
    dateless = rules.new_rules(r.withColumn("service_dates", F.array().cast("array<date>")))
    assert [(x.trip_id, x.service_dates) for x in dateless.collect()] == [("t1", [])]


@pytest.mark.parametrize(("text", "seconds"), [("8:05", 29100), (" 8:05:09x", 29109), ("25:00:00", 90000), ("8", None), ("", None), (None, None), ("x:1", None), ("8:05:", 29100)])
def test_durations(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "v string").select(cx.duration_seconds("v")).first()[0] == seconds


def test_uri_templates(spark):
    df = spark.sql("SELECT named_struct('trip_id', 'a b/c~(d)\\'', 'startTime', timestamp'2020-02-15 23:30:00') AS trip, named_struct('route_id', 'B1234-56789') AS route, named_struct('stop_id', '1') AS departureStop, named_struct('stop_id', '2') AS arrivalStop, timestamp'2018-09-21 10:25:12' AS departureTime, timestamp'2018-09-21 11:00:00' AS arrivalTime, '7' AS some")

    def fill(template, resolve=None, zone="UTC"):
        made = uris.Compiler(uris.Templates.of({"resolve": resolve or {}}), zone)
        return df.select(made.fill(template, uris.row_roots(df))).first()[0]

    assert fill("x/{trips.trip_id}") == "x/a%20b%2Fc~(d)'"
    assert fill("{short}", {"short": "connection.route.route_id.substring(0,5)"}) == "B1234"
    assert fill("{r}", {"r": "routes.route_id.substring(7, 5);"}) == "-5"
    assert fill("{trips.startTime(yyyyMMdd)}", zone="Asia/Tokyo") == "20200216"
    assert fill("{t}/{connection.departureTime(HHmm)}", {"t": "format(trips.startTime, \"yyyyMMdd'T'HHmm\");"}) == "20200215T2330/1025"
    assert fill("{connection.departureStop.stop_code}{connection.arrivalStop}{connection.some}{nothing}{routes.none}") == "127"
    for bad in ("process.exit(1)", "trips.trip_id + 1"):
        with pytest.raises(ValueError, match="Unsupported base URI resolver"):
            fill("{x}", {"x": bad})
    with pytest.raises(ValueError, match="date pattern"):
        fill("{trips.startTime(do)}")


def test_formats(spark):
    r = rules.rules(*feed(spark, [("t1", "8:00", "8:00", "A", "1", "3", "0"), ("t1", "9:00", "9:00", "B", "2", "", "9")]))
    c = cx.connections(r).where("service_date = '2024-03-30'")
    row = lambda fmt: formats.rows_of(fmt, c).first().value
    assert row("csv") == '"A","2024-03-30T08:00:00.000Z","B","2024-03-30T09:00:00.000Z","t1","r","Head"'
    assert row("jsonld") == (
        '{"@id":"http://example.org/connections/20240330/A/t1","@type":"Connection","departureStop":"http://example.org/stops/A","arrivalStop":"http://example.org/stops/B","departureTime":"2024-03-30T08:00:00.000Z",'
        '"arrivalTime":"2024-03-30T09:00:00.000Z","gtfs:trip":"http://example.org/trips/t1/20240330","gtfs:route":"http://example.org/routes/r","direction":"Head","gtfs:pickupType":"gtfs:MustCoordinateWithDriver"}'
    )
    assert row("mongold").endswith('"_id":"http://example.org/connections/20240330/A/t1"}') and '"departureTime":{"$date":"2024-03-30T08:00:00.000Z"}' in row("mongo")
    assert '"extra":"mine"' in row("json") and '"startTime":"2024-03-30T08:00:00.000Z"' in row("json")
    assert row("ntriples").count(" .\n") == 9 and row("ntriples").endswith("MESSAGE") and row("turtle").startswith("<http://example.org/connections/20240330/A/t1> a lc:Connection;")
    with pytest.raises(ValueError, match="Unsupported format"):
        row("xml")


def test_message_numbers_are_dense(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), "id")
    got = formats.message_numbers(df, ["g"], ["id"]).orderBy("g", "id").collect()
    assert [r.message_id for r in got] == list(range(50))


def test_numbers_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), F.col("id").alias("message_id0"), (F.col("id") * 7 % 5000).alias("id"))
    got = formats.message_numbers(df.repartition(7), ["g"], ["id"]).collect()
    assert [(r.g or "", r.id) for r in sorted(got, key=lambda r: r.message_id)] == sorted((r.g or "", r.id) for r in got) and {r.message_id for r in got} == set(range(5000))
    assert formats.message_numbers(df.where("false"), ["g"], ["id"]).count() == 0


def test_trips_are_dealt_out(spark):
    st = spark.createDataFrame([(t,) for t in ("b", "a", None, "c", "a", "", "d")], "trip_id string")
    got = {r.trip_id: r.shard for r in rules.deal_trips(st, 2).collect()}
    assert got == {None: 0, "": 1, "a": 0, "b": 1, "c": 0, "d": 1}


def test_dropped_pairs_name_what_they_lack(spark):
    st, stops, trips, routes, _ = feed(spark, [("t1", "8:00", "8:00", "A", "1", "", ""), ("t1", "9:00", "9:00", "Z", "2", "", ""), ("t9", "8:00", "8:00", "A", "1", "", ""), ("t9", "9:00", "9:00", "B", "2", "", ""), ("", "9:00", "9:00", "B", "2", "", "")])
    got = {(r.trip_id, r.missing, r.key) for r in rules.dropped_pairs(st, stops, trips, routes).collect()}
    assert got == {("t1", "arrival_stop", "Z"), ("t9", "trip", "t9")}
    assert {r.missing for r in rules.dropped_pairs(st, stops, trips, routes.where("false")).collect()} == {"arrival_stop", "trip"}


def test_movements_without_rows_times_or_trips(spark):
    columns = "`@id` string, departureStop string, arrivalStop string, departureTime string, arrivalTime string, `gtfs:trip` string, `gtfs:route` string, `gtfs:pickupType` string, `gtfs:dropOffType` string, extra string, _ord bigint"
    assert linking.join_and_sort(spark.createDataFrame([], columns)).count() == 0
    rows = [(None, None, None, None, None, None, None, None, None, "x", 1), ("a", "A", "B", None, None, "t", "r", "gtfs:NotAvailable", None, "y", 2), ("b", "A", "B", None, None, "u", "r", None, None, None, 3)]
    got = {r["@id"]: (r.extra, r.nextConnection) for r in linking.join_and_sort(spark.createDataFrame(rows, columns)).collect()}
    assert got == {None: ("x", None), "b": (None, None)}


def test_rules_by_hop_are_the_new_rules(spark, monkeypatch):
    """Repeated content, several services, blank times and hops of one rule: as `new_rules` gives them, without a checkpoint of whole rules."""
    rng = random.Random(3)
    times = [(f"t{i}", t, t if rng.random() < 0.8 else "", s, str(k), rng.choice("01"), "0") for i in range(60) for k, (t, s) in enumerate(zip(("8:00", rng.choice(("8:10", "x", "")), "9:00"), rng.sample("ABCD", 3)))]
    st, stops, _, _, _ = feed(spark, times)
    trips = spark.createDataFrame([(f"t{i}", rng.choice("rq"), rng.choice("abc")) for i in range(55)], "trip_id string, route_id string, service_id string")
    routes = spark.createDataFrame([("r", "Long Name"), ("q", "LongName")], "route_id string, route_long_name string")
    dates = cal.service_dates(calendar_rows(spark, [("a", *"1111111", "20240330", "20240402", 1), ("b", *"1111111", "20240401", "20240404", 1)]), spark.createDataFrame([], "service_id string, date string, exception_type string"))
    row = lambda r: (r.trip_id, r._seq, r.rule_key, tuple(r.service_dates))
    expected = sorted(row(r) for r in rules.new_rules(rules.rules(st, stops, trips, routes, dates), keep_dateless=False).collect())
    monkeypatch.setattr(type(st), "checkpoint", None)
    alone, others = rules.fresh_rules(st, stops, trips, routes, dates)
    got = [row(r) for df in (alone, others) for r in df.where("size(service_dates) > 0").collect()]
    assert sorted(got) == expected and len(expected) > 20
    assert not {r._hop for r in alone.collect()} & {r._hop for r in others.collect()}


@pytest.mark.parametrize(("name", "as_many_as"), [("ntriples_messages", "connections"), ("join_and_sort", "movement_fold")])
def test_rows_without_a_checkpoint(spark, monkeypatch, name, as_many_as):
    """What is kept is keys of stop pairs, not whole rules."""
    from headway.plans import catalogue

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", None)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() == catalogue.QUERIES[as_many_as](spark, "/root/testdata/sf0.001").count()


def test_movements_stay_where_their_hop_is(spark):
    """Rows shuffled by hop are folded without another shuffle, with the same result."""
    rows = [(f"c{i % 7}{i}", "A", "B", f"0{i % 3}", "09", f"t{i}", "r", "gtfs:NotAvailable" if i % 2 else None, None, i, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, _hop bigint")
    by_hop = linking.merge_movements(df.repartition(4, "_hop"))
    assert by_hop._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    key = lambda r: (r["@id"], r._slot, r.joinedWithTrip, r.willSplitInto)
    assert sorted(map(key, by_hop.collect()), key=str) == sorted(map(key, linking.merge_movements(df.drop("_hop")).collect()), key=str)


@pytest.mark.parametrize("text", ["2024-02-29 00:00:00", "1969-12-31 23:59:59.999", "2024-10-27 10:05:09.120", None])
def test_iso_is_the_pattern(spark, text):
    ts = F.lit(text).cast("timestamp")
    assert spark.range(1).select(cx.iso(ts).eqNullSafe(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).first()[0]


def plan_of(spark, name):
    from headway.plans import catalogue

    return catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_places_need_no_shuffle_by_movement(spark):
    assert not [x for x in plan_of(spark, "sort_descending").splitlines() if "hashpartitioning" in x and "departureTime" in x]


def test_next_connections_need_no_shuffle_by_uri(spark):
    assert not [x for x in plan_of(spark, "next_connection_lead").splitlines() if "hashpartitioning" in x and "gtfs:trip" in x]


def test_names_of_predicates_are_known_before_rows(spark):
    assert "regexp_extract(q" not in plan_of(spark, "quads")


def test_texts_are_not_shuffled_for_the_final_order(spark):
    """Of rules in their order and dates, join_and_sort gives what the operators give of connections, in the same order."""
    from headway.plans import transit

    plan = plan_of(spark, "join_and_sort")
    assert not [x for x in plan.splitlines() if "partitioning(" in x and ("departureTime" in x or "gtfs:trip" in x or "@id" in x)]
    merged = transit._merged(spark, "/root/testdata/sf0.001")
    expected = linking.sort(linking.link_next(merged)).withColumn("nextConnection", F.array_join("nextConnection", " ")).collect()
    got = transit.join_and_sort(spark, "/root/testdata/sf0.001").collect()
    assert got == expected and {len((r.nextConnection or "").split()) for r in got} >= {0, 1}
