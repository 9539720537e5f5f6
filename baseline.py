"""Single-thread figures to hold the bench against: the same work in plain Python, one row at a time.

Prints one JSON line with seconds for the rules, the dated connections and the second
pass over them, of the warehouse feed in $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

BOARDING = {"0": "gtfs:Regular", "1": "gtfs:NotAvailable"}


def rows(directory: str, name: str, *columns: str) -> list[tuple]:
    table = pq.read_table(f"{directory}/{name}.parquet", columns=list(columns))
    return list(zip(*(table.column(c).to_pylist() for c in columns)))


def service_days() -> dict[str, list[date]]:
    from headway.plans.adapter import CALENDAR, CALENDAR_DATES

    day = lambda t: datetime.strptime(t, "%Y%m%d").date()
    added, removed, out = {}, {}, {}
    for service, text, kind in CALENDAR_DATES:
        {"1": added, "2": removed}.get(kind, {}).setdefault(service, []).append(day(text))
    for service, mask, a, b in CALENDAR:
        first, last = sorted((day(a), day(b)))
        span = [first + timedelta(i) for i in range((last - first).days + 1)]
        running = [d for d in span if mask[d.weekday()] == "1" and d not in removed.get(service, ())]
        out[service] = list(dict.fromkeys([*added.get(service, ()), *running]))
    return {**{s: d for s, d in added.items()}, **out}


def rules(directory: str) -> list[tuple]:
    items = rows(directory, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    nation_of = dict(rows(directory, "customer", "c_custkey", "c_nationkey"))
    names = dict(rows(directory, "nation", "n_nationkey", "n_name"))
    codes = {k: "" if k % 3 == 0 else n for k, n in rows(directory, "supplier", "s_suppkey", "s_name")}
    trips = {k: (nation_of[c], p, "" if s == "P" else s) for k, c, p, s in rows(directory, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus") if c in nation_of}
    items.sort(key=lambda r: r[:5])
    out, trip, n, prev, start = [], None, 0, None, ""
    for order, _, _, stop, _, flag, status in items:
        n = n + 1 if order == trip else 1
        arrives = leaves = ""
        if n % 7 != 4:
            m = 360 + n * 10
            arrives, leaves = f"{(m - 1) // 60:02d}:{(m - 1) % 60:02d}:00", f"{m // 60:02d}:{m % 60:02d}:00"
        if order != trip:
            trip, prev, start = order, None, leaves
        if prev is not None and (arrives or leaves) and order in trips and prev[0] in codes and stop in codes:
            route, service, sign = trips[order]
            pickup, drop = prev[2], "0" if status == "F" else "1"
            key = "/".join((names[route].replace(" ", ""), "", codes[prev[0]] or str(prev[0]), codes[stop] or str(stop), start, prev[1], arrives, pickup, drop))
            out.append((key, str(order), n, route, service, sign or names[route], prev[0], stop, start, prev[1], arrives, pickup, drop))
        prev = (stop, leaves, {"A": "0", "N": "1"}.get(flag, ""))
    return out


def connections(found: list[tuple]) -> list[dict]:
    days, seen, out = service_days(), set(), []

    def at(day: date, text: str) -> str | None:
        if not text:
            return None
        h, m, s = map(int, text.split(":"))
        return (datetime(day.year, day.month, day.day) + timedelta(hours=h, minutes=m, seconds=s)).strftime("%Y-%m-%dT%H:%M:%S.000Z")

    for key, trip, _, route, service, sign, dep, arr, start, leaves, arrives, pickup, drop in found:
        for day in days.get(service, ()):
            if (key, day) in seen:
                continue
            seen.add((key, day))
            begun = f"{day:%Y%m%d}"
            row = {
                "@id": f"http://example.org/connections/{begun}/{dep}/{trip}", "@type": "Connection", "departureStop": f"http://example.org/stops/{dep}", "arrivalStop": f"http://example.org/stops/{arr}",
                "departureTime": at(day, leaves), "arrivalTime": at(day, arrives), "gtfs:trip": f"http://example.org/trips/{trip}/{begun}", "gtfs:route": f"http://example.org/routes/{route}", "direction": sign,
                "gtfs:pickupType": BOARDING.get(pickup), "gtfs:dropOffType": BOARDING.get(drop),
            }
            out.append(row)
    return out


def second_pass(linked: list[dict]) -> int:
    order = ("departureTime", "arrivalTime", "gtfs:route", "departureStop", "arrivalStop", "@id")
    place = lambda r: tuple(r[k] or "" for k in order)
    linked.sort(key=place, reverse=True)
    rank = lambda r: (r["gtfs:pickupType"] == "gtfs:NotAvailable", r["gtfs:dropOffType"] == "gtfs:NotAvailable")
    latest, hosts, out, lead = {}, {}, [], None

    def give(r: dict) -> None:
        for trip in r.pop("joined", ()):
            hosts[trip] = r["gtfs:trip"]
        split, after = r.pop("split", ()), latest.get(r["gtfs:trip"])
        if after:
            r["next"] = [after[0], *(latest[t][0] for t in split if t in latest and not after[1])]
        elif hosts.get(r["gtfs:trip"]) in latest:
            r["next"] = [latest[hosts[r["gtfs:trip"]]][0]]
        latest[r["gtfs:trip"]] = (r["@id"], bool(split))
        out.append(r)

    for r in linked:
        if lead is not None and place(r)[:5] == place(lead)[:5] and rank(r) != rank(lead):
            low, high = sorted((r, lead), key=rank)
            low.setdefault("joined" if rank(low)[0] != rank(high)[0] else "split", []).append(high["gtfs:trip"])
            lead = low
            continue
        if lead is not None:
            give(lead)
        lead = r
    if lead is not None:
        give(lead)
    out.sort(key=place)
    return len(out)


def main() -> None:
    directory, taken = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), {}
    began = time.time()
    found = rules(directory)
    taken["rule_join"] = time.time() - began
    began = time.time()
    linked = connections(found)
    taken["jsonld_rows"] = taken["rule_join"] + time.time() - began
    began = time.time()
    n = second_pass(linked)
    taken["join_and_sort"] = taken["jsonld_rows"] + time.time() - began
    print(json.dumps({"metric": "seconds of one thread, cumulative", "unit": "sec", "queries": {k: round(v, 2) for k, v in taken.items()}, "rules": len(found), "connections": len(linked), "folded": n, "sf": os.path.basename(directory)}))


if __name__ == "__main__":
    main()
