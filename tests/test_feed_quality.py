"""Small fixtures for the feed quality operators, against brute force and by hand."""

import random
import re
from datetime import datetime as dt

from brute_times import date_value, time_value
from pyspark.sql import functions as F
from zoneinfo import ZoneInfo

from headway.functions.text import strip_to_null
from headway.operators import fill, orphans, reject, snapshot_diff, time_forms
from headway.plans.feed_quality import _days, _seconds

SNAPSHOT = "snapshot_no int, trip_id string, stop_sequence int, departure_dfm string, service_dates array<string>, extra string"


def changes(df, levels=None):
    content = [F.coalesce(c, F.lit("\0")) for c in (_seconds("departure_dfm"), _days("service_dates"))]
    return {tuple(r) for r in snapshot_diff.diff_snapshots(df, "snapshot_no", ["trip_id", "stop_sequence"], content, levels).collect()}


def test_snapshots_compare_by_meaning(spark):
    rows = [
        (1, "a", 1, "8:00", ["20250101", "2025-01-02"], "x"), (1, "a", 1, "08:00:00", ["20250102", "20250101", None, " "], "y"), (1, "b", 1, "9:00", None, ""),
        (1, "c", 1, "9:00", [], ""), (1, None, None, None, None, None), (3, "a", 1, " 08:00 ", ["20250102", "20250101", "20250101"], ""), (3, "b", 1, "9:01", None, ""),
        (3, "d", 1, "9:00", None, ""), (3, None, None, None, None, None), (None, "z", 1, "1:00", None, ""),
    ]
    df = spark.createDataFrame(rows, SNAPSHOT)
    assert changes(df) == {(1, 3, "b", 1, "changed"), (1, 3, "c", 1, "removed"), (1, 3, "d", 1, "added")}
    assert changes(df.where("false")) == set() and changes(df.where("snapshot_no = 1")) == set()


def test_snapshots_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(s, f"t{rng.randrange(40)}", rng.randrange(3), f"{rng.randrange(3)}:00", None, "") for s in (1, 2, 5, 9) for _ in range(120)]
    by = {}
    for s, t, q, time, *_ in rows:
        by.setdefault(s, {}).setdefault((t, q), set()).add(time)
    expected = set()
    for a, b in ((1, 2), (2, 5), (5, 9)):
        for k in by[a].keys() | by[b].keys():
            kind = "added" if k not in by[a] else "removed" if k not in by[b] else "changed" if by[a][k] != by[b][k] else None
            if kind:
                expected.add((a, b, *k, kind))
    assert changes(spark.createDataFrame(rows, SNAPSHOT), (0, 2, 4)) == expected


def test_levels_follow_the_rows():
    assert snapshot_diff.tree_levels(0) == (0, 2) and snapshot_diff.tree_levels(10**6) == (0, 2, 8, 14) and snapshot_diff.tree_levels(10**12)[-1] == 30
    assert all(b - a <= snapshot_diff.STEP for n in range(40) for a, b in zip(snapshot_diff.tree_levels(2**n), snapshot_diff.tree_levels(2**n)[1:]))


def test_only_the_last_delivery_counts(spark):
    df = spark.createDataFrame([(1, 2, "old"), (1, 3, "new"), (2, 1, "x")], "snapshot_no int, delivery_no int, v string")
    assert {r.v for r in snapshot_diff.last_delivery(df, "snapshot_no", "delivery_no").collect()} == {"new", "x"}


CHILD = "row_id int, ref string, loaded_at timestamp_ntz, reason string, _key string"
PARENT = "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, ref string"


def test_orphans_against_brute_force(spark):
    rng = random.Random(9)
    day = lambda: dt(2025, 1, rng.randrange(1, 28))
    parents = [(rng.choice(["a", "b ", "\tc", "d", " ", None, "hot"]), day(), rng.choice([None, day()]), "x") for _ in range(40)] + [("hot", dt(2025, 1, 1), dt(2025, 1, 9), "")] * 20
    children = [(i, rng.choice(["a", " b", "c", "d", "D", "none", "", " \t", None, "hot"]), rng.choice([day(), day(), None]), "r", "k") for i in range(150)]
    expected = set()
    for i, ref, at, *_ in children:
        ref = (ref or "").strip(" \t")
        own = [p for p in parents if (p[0] or "").strip(" \t") == ref]
        if not ref:
            continue
        if not own:
            expected.add((i, "missing"))
        elif at is not None and not any(a <= at and (b is None or b > at) for _, a, b, _ in own):
            expected.add((i, "late" if all(a > at for _, a, *_ in own) else "deleted"))
    for blocks in (None, 8):
        found = orphans.orphan_references(spark.createDataFrame(children, CHILD), ["ref"], "loaded_at", ["row_id"], {"ref": (spark.createDataFrame(parents, PARENT), "key")}, blocks=blocks)
        assert sorted((r.row_id, r.reason) for r in found.collect()) == sorted(expected)


def test_orphans_of_two_fields_keep_columns_of_any_name(spark):
    child = spark.createDataFrame([(1, "a", "x", dt(2025, 1, 1), "s"), (2, None, "y", dt(2025, 1, 1), None), (3, "b", "x", dt(2025, 1, 1), "s")] * 2, "id int, one string, two string, loaded_at timestamp_ntz, state string")
    one = spark.createDataFrame([("a", dt(2024, 1, 1), None, "")], PARENT)
    two = spark.createDataFrame([("x", dt(2025, 2, 1), None, ""), ("a", dt(2024, 1, 1), None, "")], PARENT)
    got = orphans.orphan_references(child, ["one", "two"], "loaded_at", ["id", "state"], {"one": (one, "key"), "two": (two, "key")}).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "s", "two", "late"), (2, None, "two", "missing"), (3, "s", "one", "missing"), (3, "s", "two", "late")] * 2))


def test_mixtures_weigh_forms_and_follow_more_evidence(spark):
    """A thousand days that only month-first reads overrule a declared order; a few don't."""
    declared = spark.createDataFrame([("many", "UTC", "DMY"), ("few", "UTC", "DMY")], "source string, zone string, declared string")
    rows = [(f"{s}{i}", s, f"0{1 + i % 9}/{13 + i % 16}/2025") for s, n in (("many", 20000), ("few", 9)) for i in range(n)] + [(f"{s}-open", s, "02/03/2025") for s in ("many", "few")]
    got = {r.id: r.norm_value for r in time_forms.normalise_dates(spark.createDataFrame(rows, "id string, source string, value string"), declared, ["id"]).collect()}
    assert got["many-open"] == "2025-02-03" and got["few-open"] == "2025-03-02"


def test_abbreviations_are_those_of_the_zone(spark):
    zones = spark.createDataFrame([("in", "Asia/Kolkata", "DMY"), ("il", "Asia/Jerusalem", "DMY"), ("cn", "Asia/Shanghai", "DMY"), ("us", "America/Chicago", "MDY"), ("be", "Europe/Brussels", "DMY")], "source string, zone string, declared string")
    rows = [(s, s, f"2025-01-15 12:00:00 {z}") for s, z in (("in", "IST"), ("il", "IST"), ("cn", "CST"), ("us", "CST"), ("be", "CST"))]
    df = spark.createDataFrame(rows, "id string, source string, value string").withColumn("day", F.lit("2025-01-15").cast("date"))
    got = {r.id: r.norm_value[11:13] for r in time_forms.normalise_times(df, zones, ["id"]).collect()}
    assert got == {"in": "06", "il": "10", "cn": "04", "us": "18", "be": ""}  # `unresolved` where the zone has none


def test_orphans_of_nothing(spark):
    none = spark.createDataFrame([], PARENT)
    child = spark.createDataFrame([(1, "a", dt(2025, 1, 1), "", "")], CHILD)
    assert [tuple(r) for r in orphans.orphan_references(child, ["ref"], "loaded_at", ["row_id"], {"ref": (none, "key")}).collect()] == [(1, "ref", "missing")]
    assert orphans.orphan_references(child.where("false"), ["ref"], "loaded_at", ["row_id"], {"ref": (none, "key")}).count() == 0


def test_filter_never_rejects_a_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    probed = orphans.probe(keys, F.col("key"), orphans.bloom_blocks(keys, "key", 64), 64)
    assert probed.where("not _maybe").count() == 0
    others = spark.range(3000).select(F.concat(F.lit("x"), "id").alias("key"))
    blocks = orphans.blocks_for(3000)
    assert orphans.probe(others, F.col("key"), orphans.bloom_blocks(keys, "key", blocks), blocks).where("_maybe").count() < 60
    most, orphans.MOST_BLOCKS = orphans.MOST_BLOCKS, 1  # filters beyond the bound are joined, not broadcast
    try:
        joined = orphans.probe(keys, F.col("key"), orphans.bloom_blocks(keys, "key", 64), 64)
        assert joined.where("_maybe").count() == 3000 and "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    finally:
        orphans.MOST_BLOCKS = most


def filled(df, **kw):
    out = fill.fill_in_order(df, strip_to_null("e"), F.col("x"), {"n": F.col("n").cast("bigint")}, {"c": F.col("c")}, ["id"], **kw)
    return {(r.id, r.field_name): (r.value, r.method, r.distance) for r in out.collect()}


def test_filling_in_order(spark):
    rows = [
        (1, "a", 0, 10, "u"), (2, " a", 2, None, None), (3, "a", 4, 30, None), (4, "a", 9, None, None), (5, "a", 4, None, None), (6, "b", 1, None, None), (7, None, 1, None, None), (8, "", 1, 5, "q"),
        (9, "c", 5000, 7, "w"), (10, "c", 1, None, None), (11, "c", None, None, None), (12, "c", 9000, 15, None), (13, "c", 7000, None, None),
    ]
    got = filled(spark.createDataFrame(rows, "id int, e string, x int, n int, c string"))
    assert got == {
        (2, "n"): ("20", "interpolated", 2), (2, "c"): ("u", "carried_forward", 2), (4, "n"): ("30", "held_forward", 5), (5, "n"): ("30", "same_place", 0),
        (10, "n"): ("7", "held_back", 4999), (11, "n"): ("7", "held_back", 5000), (13, "n"): ("11", "interpolated", 2000),
    }
    assert filled(spark.createDataFrame([], "id int, e string, x int, n int, c string")) == {}


def test_filling_across_chunks_is_filling_within(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(6000), rng.choice([None, rng.randrange(99)]), None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, e string, x int, n int, c string")
    chunk, fill.CHUNK = fill.CHUNK, 10**9
    try:
        whole = filled(df)
    finally:
        fill.CHUNK = chunk
    assert filled(df) == whole and len(whole) > 100


RAW = "row_id int, file_name string, line_no int, raw string, reason string"
GOOD = "t1,8:00:00,8:00:30,s1,{},{},{},0,1.5"


def test_records_set_aside(spark):
    lines = {
        GOOD.format("1", "x", "0"): [], GOOD.format(" 7\t", '"a, ""b"" \n c"', "") + "\r": [], GOOD.format("2147483647", "", '"3"'): [], GOOD.format("2147483648", "", "0"): ["stop_sequence"],
        GOOD.format("00000000000012", "", "0"): [], GOOD.format("", "", "4"): ["pickup_type", "stop_sequence"], GOOD.format("١", "", "0"): ["stop_sequence"], GOOD.format("1", 'a"b', "0"): ["quoting"],
        GOOD.format("1", '"a" "b"', "0"): ["quoting"], GOOD.format("1", ' "a"', "0"): ["quoting"], GOOD.format("1", '"a', "0"): ["quoting"], GOOD.format("1", "x,y", "0"): ["column_count"],
        "a;b": ["column_count"], "": ["column_count"], None: ["column_count"], '"' * 5: ["quoting"], "x" * 20000: ["column_count"],
    }
    day = "s,1,1,1,1,1,0,0,{},20251231"
    days = {"20250228": [], " 20240229 ": [], "20250229": ["start_date"], "2025-02-01": ["start_date"], "": ["start_date"], "２０２５０６０６": ["start_date"]}
    rows = [(i, "stop_times.txt", i + 2, x, "") for i, x in enumerate(lines)] + [(100 + i, "calendar.txt", i + 2, day.format(x), "") for i, x in enumerate(days)]
    rows += [(900, "stop_times.txt", 1, 'head"er', ""), (901, "other.txt", 2, "a", "")]
    df = spark.createDataFrame(rows, RAW)
    got = {}
    for r in reject.rejected_records(df, ["row_id"]).collect():
        got.setdefault(r.row_id, []).append(r.reason)
    expected = {i: v for i, v in enumerate(lines.values()) if v} | {100 + i: v for i, v in enumerate(days.values()) if v} | {901: ["column_count"]}
    assert {k: sorted(v) for k, v in got.items()} == expected
    loaded = reject.loaded_records(df, "stop_times.txt", ["row_id"]).collect()
    assert {r.row_id for r in loaded} == {i for i, v in enumerate(lines.values()) if not v}
    assert next(r for r in loaded if r.row_id == 1).stop_headsign == 'a, "b" \n c'
    assert reject.rejected_records(df.where("false"), ["row_id"]).count() == 0


def test_repairs_cost_least():
    assert reject.repair("a,b,c", 3) == (0, "")
    assert reject.repair("a,b", 3) == (1, "insert_delimiter:1")
    assert reject.repair("a,b,c,d", 3) == (1, "delete_delimiter:1")
    assert reject.repair('a,"b,c', 3) == (1, "delete_quote:1")
    assert reject.repair('a,b"x,c', 3)[0] == 1
    assert reject.repair("", 1) == (0, "")
    assert reject.repair("a", 9) == (8, "insert_delimiter:8") and reject.repair('"' * 40001, 1)[0] == 1


def _parses(text):
    """The number of fields of a record that parses, by hand; 0 if it doesn't."""
    fields, rest = 0, text + ","
    while rest:
        m = re.match(r'("(?:[^"]|"")*"|[^",]*),', rest, re.S)
        if not m:
            return 0
        fields, rest = fields + 1, rest[m.end() :]
    return fields


def test_repairs_against_search():
    """Breadth first over all single edits of short records."""
    rng = random.Random(5)
    texts = ["".join(rng.choice('a",b') for _ in range(rng.randrange(7))) for _ in range(60)]
    assert list(reject.free_parses([t.encode() for t in texts])) == [_parses(t) for t in texts]
    for want in (1, 2, 3):
        for text, (cost, _) in zip(texts, reject.repairs([t.encode() for t in texts], want)):
            level, near = 0, {text}
            while level < 3 and not any(_parses(t) == want for t in near):
                near = {t[:i] + x + t[i:] for t in near for i in range(len(t) + 1) for x in '",'} | {t[:i] + t[i + 1 :] for t in near for i in range(len(t)) if t[i] in '",'}
                level += 1
            assert cost == level or level == 3 and cost >= 3, (text, want)


ZONES = {"be": ("Europe/Brussels", "DMY"), "us": ("America/New_York", "MDY"), "in": ("Asia/Kolkata", "DMY")}
TIMES = (
    "8:05", "08:05:07.9", "25:01:02", "8h05", "04h20m30s", "042956", "1:05 p.m.", "12:00am", "12:30 PM", "08.05.07", "99:99:99", "08:60", "n/a", "", None, "1737899381", "1737451200803",
    "2025-03-30T02:30:00", "2025-10-26 02:30", "2025-10-26 02:30:00 CEST", "2025-03-09 02:30:00", "2025-11-02 01:30:00 America/New_York", "2025-06-01 10:00:00[Asia/Tokyo]",
    "02/03/2025 10:00", "02.03.2025 10:00:00 CET", "13/02/2025 10:00", "2025-06-01T10:00:00+05:45", "20250601T100000Z", "20250601T100000 EST", "1 Jun 2025 10:00:00", "2025-06-01T10:00:00 -07:00", "\t8:05:00 ",
)
DATES = (
    "2025-06-01", "02/03/2025", "13/02/2025", "02.03.25", "2025/6/1", "2025-152", "1 Jun 2025", "Jun 1, 2025", "Sunday 1 June 2025", "01-JUN-2025", "20250601120000", "1737899381",
    "2025-06-01 23:30:00 UTC", "2025-06-01T02:00:00-0800", "2025-06-01 00:30 CEST", "2025-06-01 12:00", " 20250601",
)


def sources(spark):
    return spark.createDataFrame([(a, z, o) for a, (z, o) in ZONES.items()], "source string, zone string, declared string")


def test_times_against_brute_force(spark):
    rows = [(f"{a}{i}", a, v) for a in ZONES for i, v in enumerate(TIMES)]
    df = spark.createDataFrame(rows, "id string, source string, value string").withColumn("day", F.lit("2025-03-30").cast("date"))
    got = {r.id: r.norm_value for r in time_forms.normalise_times(df, sources(spark), ["id"]).collect()}
    expected = {}
    for i, a, v in rows:
        zone, order = ZONES[a]
        if v and ("13/02" in v) and order == "MDY":
            order = "DMY"  # only this reading is a day
        n = time_value(v, "20250330", ZoneInfo(zone), order)
        if n:
            expected[i] = n
    assert got == expected


def test_dates_against_brute_force(spark):
    rows = [(f"{a}{i}", a, v) for a in ZONES for i, v in enumerate(DATES)]
    df = spark.createDataFrame(rows, "id string, source string, value string")
    got = {r.id: r.norm_value for r in time_forms.normalise_dates(df, sources(spark), ["id"]).collect()}
    assert got == {i: date_value(v, ZoneInfo(ZONES[a][0]), "DMY" if "13/" in v else ZONES[a][1]) for i, a, v in rows}
    odd = spark.createDataFrame([("x", "be", "30.02.2025"), ("y", "be", "word"), ("z", None, "2025-01-01")], "id string, source string, value string")
    assert {r.id: r.norm_value for r in time_forms.normalise_dates(odd, sources(spark), ["id"]).collect()} == {"x": "nonexistent", "z": "2025-01-01"}


def test_orders_are_learnt_where_none_is_declared(spark):
    silent = spark.createDataFrame([("m", "UTC", None), ("o", "UTC", None)], "source string, zone string, declared string")
    values = [f"{m:02d}/{d:02d}/2025" for m in (1, 2, 3) for d in range(13, 29)] + ["02/03/2025"]
    df = spark.createDataFrame([(str(i), "m", v) for i, v in enumerate(values)] + [("only", "o", "02/03/2025")], "id string, source string, value string")
    got = {r.id: r.norm_value for r in time_forms.normalise_dates(df, silent, ["id"]).collect()}
    assert got[str(len(values) - 1)] == "2025-02-03" and got["only"] == "ambiguous"
