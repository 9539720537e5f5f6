"""Connections in the output formats: projections, text rows and RDF messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.text import some
from headway.functions.uris import Templates, uri_columns
from headway.operators.connections import iso
from headway.operators.numbering import numbered

# Vocabularies, boarding types by code, and the JSON-LD context. That of connections is the caller's, in `Templates`.
GTFS, XSD = "http://vocab.gtfs.org/terms#", "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
BOARDING = ("Regular", "NotAvailable", "MustPhone", "MustCoordinateWithDriver")
FORMATS = ("json", "jsonld", "mongo", "mongold", "csv", "turtle", "ntriples", "jelly")
EXTENSIONS = {"json": "json", "jsonld": "json", "mongo": "json", "mongold": "json", "csv": "csv", "turtle": "ttl", "ntriples": "nt", "jelly": "jelly"}
CSV_COLUMNS = ("departureStop", "departureTime", "arrivalStop", "arrivalTime", "trip", "route", "headsign")
_HELPERS = ("service_date", "trip_id", "_seq", "_ord", "_hop", "_slot", "_rule")


def boarding(code: Column, prefix: str) -> Column:
    """Name of a boarding code; NULL for blank and unknown ones."""
    known = F.create_map(*[F.lit(x) for i, name in enumerate(BOARDING) for x in (str(i), prefix + name)])
    return F.try_element_at(known, code)


def to_json_rows(connections: DataFrame) -> DataFrame:
    """(value): nested connections, one JSON object a row; NULLs are kept."""
    columns = [c for c in connections.columns if c not in _HELPERS]
    rows = connections.withColumns({"departureTime": iso(F.col("departureTime")), "arrivalTime": iso(F.col("arrivalTime")), "trip": F.col("trip").withField("startTime", iso(F.col("trip.startTime")))})
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"), *_kept(connections))


def _kept(df: DataFrame) -> list[str]:
    return [c for c in _HELPERS if c in df.columns]


def to_mongo_rows(connections: DataFrame) -> DataFrame:
    """As `to_json_rows`, with departure and arrival as extended JSON dates."""
    columns = [c for c in connections.columns if c not in _HELPERS]
    date = lambda c: F.struct(iso(F.col(c)).alias("$date"))
    rows = connections.withColumns({"trip": F.col("trip").withField("startTime", iso(F.col("trip.startTime"))), "departureTime": date("departureTime"), "arrivalTime": date("arrivalTime")})
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"), *_kept(connections))


def linked(connections: DataFrame, templates: Templates | None = None, timezone: str = "UTC") -> DataFrame:
    """Flat linked connections, with URIs; `direction` and boarding types are NULL where not given."""
    uri = uri_columns(connections, templates or Templates(), timezone)
    return connections.select(
        uri["@id"].alias("@id"), F.lit("Connection").alias("@type"), uri["departureStop"].alias("departureStop"), uri["arrivalStop"].alias("arrivalStop"),
        iso(F.col("departureTime")).alias("departureTime"), iso(F.col("arrivalTime")).alias("arrivalTime"), uri["gtfs:trip"].alias("gtfs:trip"), uri["gtfs:route"].alias("gtfs:route"),
        some("headsign").alias("direction"), boarding(F.col("pickup_type"), "gtfs:").alias("gtfs:pickupType"), boarding(F.col("drop_off_type"), "gtfs:").alias("gtfs:dropOffType"),
        *_kept(connections),
    )


def _flat(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in _HELPERS]


def to_jsonld_rows(linked_rows: DataFrame) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in _flat(linked_rows)]
    return linked_rows.select(F.to_json(F.struct(*columns)).alias("value"), *_kept(linked_rows))


def to_mongold_rows(linked_rows: DataFrame) -> DataFrame:
    """Flat connections with extended JSON dates and `_id` in the last place."""
    date = lambda c: F.struct(F.col(c).alias("$date")).alias(c)
    columns = [date(c) if c in ("departureTime", "arrivalTime") else F.col(f"`{c}`") for c in _flat(linked_rows) if c != "@id"]
    return linked_rows.select(F.to_json(F.struct(*columns, F.col("`@id`").alias("_id"))).alias("value"), *_kept(linked_rows))


def csv_columns(connections: DataFrame) -> DataFrame:
    return connections.select(
        F.col("departureStop.stop_id").alias("departureStop"), iso(F.col("departureTime")).alias("departureTime"), F.col("arrivalStop.stop_id").alias("arrivalStop"),
        iso(F.col("arrivalTime")).alias("arrivalTime"), F.col("trip.trip_id").alias("trip"), F.col("route.route_id").alias("route"), F.coalesce("headsign", F.lit("")).alias("headsign"), *_kept(connections),
    )


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def to_csv_rows(connections: DataFrame) -> DataFrame:
    flat = csv_columns(connections)
    return flat.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in CSV_COLUMNS]).alias("value"), *_kept(flat))


def statements(connections: DataFrame, templates: Templates | None = None, timezone: str = "UTC") -> tuple[DataFrame, list[tuple[str, Column, str | None]]]:
    """The connections with their URIs and instants as columns, and what is stated of each: predicate, object, and a literal's datatype.

    The subject is the column `_u_id`. Objects that are not given are NULL.
    """
    templates = templates or Templates()
    # Each URI and instant is a column of its own first, so that ten statements don't compute it ten times.
    named = {"@id": "_u_id", "departureStop": "_u_dep", "arrivalStop": "_u_arr", "gtfs:trip": "_u_trip", "gtfs:route": "_u_route"}
    made = {named[k]: c for k, c in uri_columns(connections, templates, timezone).items()}
    trip_names = connections.schema["trip"].dataType.fieldNames()
    sign = F.coalesce(some("headsign"), some("trip.trip_headsign") if "trip_headsign" in trip_names else F.lit(None).cast("string"))
    made |= {"_u_leaves": iso(F.col("departureTime")), "_u_arrives": iso(F.col("arrivalTime")), "_u_sign": sign}
    lc = templates.vocabulary
    stated = [
        (RDF_TYPE, F.lit(lc + "Connection"), None), (lc + "departureStop", F.col("_u_dep"), None), (lc + "arrivalStop", F.col("_u_arr"), None), (lc + "departureTime", F.col("_u_leaves"), XSD + "dateTime"),
        (lc + "arrivalTime", F.col("_u_arrives"), XSD + "dateTime"), (GTFS + "trip", F.col("_u_trip"), None), (GTFS + "route", F.col("_u_route"), None), (GTFS + "headsign", F.col("_u_sign"), XSD + "string"),
        (GTFS + "dropOffType", boarding(F.col("drop_off_type"), GTFS), None), (GTFS + "pickupType", boarding(F.col("pickup_type"), GTFS), None),
    ]
    return connections.withColumns(made), stated


def quads(connections: DataFrame, templates: Templates | None = None, timezone: str = "UTC") -> DataFrame:
    """`connections` as one row each with `_quads`: (s, p, o, kind, datatype), seven to ten of them."""
    df, stated = statements(connections, templates, timezone)
    quad = lambda p, o, t: F.struct(F.col("_u_id").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal" if t else "iri").alias("kind"), F.lit(t).cast("string").alias("datatype"))
    return df.select(*_kept(df), F.array_compact(F.array(*[F.when(o.isNotNull(), quad(p, o, t)) for p, o, t in stated])).alias("_quads"))


def _escaped(c: Column) -> Column:
    for seen, meant in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(seen), F.lit(meant))
    return F.concat(F.lit('"'), c, F.lit('"'))


def to_ntriples_rows(connections: DataFrame, templates: Templates | None = None, timezone: str = "UTC") -> DataFrame:
    """(value): one message a row, its triples on lines of their own, closed by the delimiter."""
    df, stated = statements(connections, templates, timezone)
    lines = []
    for p, o, t in stated:
        text = F.concat(F.lit("<"), o, F.lit(">")) if t is None else _escaped(o) if t == XSD + "string" else F.concat(_escaped(o), F.lit(f"^^<{t}>"))
        lines.append(F.concat(F.lit("<"), F.col("_u_id"), F.lit(f"> <{p}> "), text, F.lit(" .")))  # NULL without an object
    return df.select(F.concat_ws("\n", *lines, F.lit("MESSAGE")).alias("value"), *_kept(df))


def prefix_names(templates: Templates | None = None) -> dict[str, str]:
    """The vocabularies by their prefixes."""
    return {"lc": (templates or Templates()).vocabulary, "gtfs": GTFS, "xsd": XSD}


def to_turtle_rows(connections: DataFrame, templates: Templates | None = None, timezone: str = "UTC") -> DataFrame:
    """(value): one message a row, its statements under one subject, closed by the delimiter."""
    templates = templates or Templates()
    df, stated = statements(connections, templates, timezone)
    bases = prefix_names(templates)

    def short(iri: str) -> str:
        return "a" if iri == RDF_TYPE else next((f"{k}:{iri[len(b) :]}" for k, b in bases.items() if iri.startswith(b)), f"<{iri}>")

    def name(c: Column) -> Column:
        out = None
        for prefix, base in bases.items():
            text = F.concat(F.lit(f"{prefix}:"), F.substring(c, F.lit(len(base) + 1), F.length(c)))
            out = F.when(c.startswith(base), text) if out is None else out.when(c.startswith(base), text)
        return out.otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    pairs = []
    for p, o, t in stated:
        text = name(o) if t is None else _escaped(o) if t == XSD + "string" else F.concat(_escaped(o), F.lit(f"^^{short(t)}"))
        pairs.append(F.concat(F.lit(f"{short(p)} "), text))
    body = F.concat(F.lit("<"), F.col("_u_id"), F.lit("> "), F.concat_ws(";\n  ", *pairs), F.lit(".\n@message ."))
    return df.select(body.alias("value"), *_kept(df))


def context(templates: Templates | None = None) -> dict:
    """The JSON-LD context of the connections' vocabulary."""
    return {
        "@context": {
            "lc": (templates or Templates()).vocabulary, "gtfs": GTFS, "xsd": XSD, "trip": {"@type": "@id", "@id": "gtfs:trip"}, "Connection": "lc:Connection", "CancelledConnection": "lc:CancelledConnection",
            "departureTime": {"@type": "xsd:dateTime", "@id": "lc:departureTime"}, "departureStop": {"@type": "@id", "@id": "lc:departureStop"},
            "arrivalStop": {"@type": "@id", "@id": "lc:arrivalStop"}, "arrivalTime": {"@type": "xsd:dateTime", "@id": "lc:arrivalTime"},
        }
    }


def header(fmt: str, templates: Templates | None = None) -> str | None:
    """What stands once before the rows."""
    prefixes = "\n".join(f"@prefix {p}: <{b}>." for p, b in prefix_names(templates).items())
    json_context = json.dumps(context(templates), separators=(",", ":"))
    return {
        "jsonld": json_context, "mongold": json_context, "csv": ",".join(f'"{c}"' for c in CSV_COLUMNS), "turtle": f'@version "1.2-messages" .\n{prefixes}', "ntriples": 'VERSION "1.2-messages"',
    }.get(fmt)


def message_numbers(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Dense numbers from 0 in order of `groups`, then `order`, as `message_id`. NULL comes first; a group of any size is spread like others."""
    return numbered(df, [F.col(c) for c in (*groups, *order)], "message_id")


def rows_of(fmt: str, connections: DataFrame, templates: Templates | None = None, timezone: str = "UTC") -> DataFrame:
    """(value, …): the text rows of a format, without its header."""
    match fmt:
        case "json":
            return to_json_rows(connections)
        case "mongo":
            return to_mongo_rows(connections)
        case "csv":
            return to_csv_rows(connections)
        case "jsonld":
            return to_jsonld_rows(linked(connections, templates, timezone))
        case "mongold":
            return to_mongold_rows(linked(connections, templates, timezone))
        case "turtle":
            return to_turtle_rows(connections, templates, timezone)
        case "ntriples":
            return to_ntriples_rows(connections, templates, timezone)
    raise ValueError(f"Unsupported format: {fmt}")
