"""URI templates and resolver expressions, compiled to Column expressions.

A template is plain text with `{name}` places, each filled percent-encoded. A name is
looked up among the configured resolvers, then as a table and column
(`trips.trip_id`, `connection.departureTime(yyyyMM)`). Resolvers are of three forms:
a path, `path.substring(a[,b])` and `format(path, 'pattern')`. Everything else is
refused when the template is compiled. Nothing runs in Python afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.operators.connections import local_text

# The templates used where none are configured.
DEFAULTS = {
    "stop": "http://example.org/stops/{stops.stop_id}",
    "route": "http://example.org/routes/{routes.route_id}",
    "trip": "http://example.org/trips/{trips.trip_id}/{trips.startTime(yyyyMMdd)}",
    "connection": "http://example.org/connections/{trips.startTime(yyyyMMdd)}/{depStop}/{trips.trip_id}",
}
DEFAULT_RESOLVE = {"depStop": "connection.departureStop.stop_id"}
# Date pattern letters whose meaning is the same in Java; the only others translated are in RENAMED.
SAME_LETTERS = set("yMdHhmsSaE")
RENAMED = {"iiii": "EEEE", "iii": "EEE"}

#: Tables that names may start from, and what they are called in a row of connections.
ROOTS = {"connection": "connection", "trips": "trip", "routes": "route", "stops": "stop"}


@dataclass(frozen=True)
class Templates:
    """URI templates with their resolvers, and the vocabulary of connections. Given templates alone leave `resolve` empty."""

    stop: str = DEFAULTS["stop"]
    route: str = DEFAULTS["route"]
    trip: str = DEFAULTS["trip"]
    connection: str = DEFAULTS["connection"]
    resolve: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_RESOLVE))
    vocabulary: str = "http://example.org/ns/connections#"

    @classmethod
    def of(cls, config: dict | None) -> Templates:
        if config is None:
            return cls()
        given = {k: config[k] for k in (*DEFAULTS, "vocabulary") if isinstance(config.get(k), str)}
        return cls(**given, resolve=dict(config.get("resolve") or {}))


def encode(value: Column) -> Column:
    """Percent-encoding of UTF-8, with spaces as %20 and the unreserved marks left alone; NULL gives nothing."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    out = F.url_encode(text)
    for seen, meant in (("+", "%20"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%21", "!")):
        out = F.replace(out, F.lit(seen), F.lit(meant))
    return F.when(text.rlike(r"\A[A-Za-z0-9._-]*\z"), text).otherwise(out)  # most ids need none of it


def java_pattern(pattern: str) -> str:
    """A date pattern for Spark; letters without the same meaning there are refused."""
    out = []
    for part in re.finditer(r"'(?:[^']|'')*'|([A-Za-z])\1*|[^A-Za-z']+|'", pattern):
        text = part.group(0)
        if part.group(1):
            text = RENAMED.get(text, text)
            if text[0] not in SAME_LETTERS:
                raise ValueError(f"Unsupported date pattern: {pattern}")
        out.append(text)
    return "".join(out)


def substring(value: Column, start: int, end: int | None) -> Column:
    """Characters from `start` up to `end`, swapped if reversed, clamped to the text."""
    if end is None:
        return F.substring(value, start + 1, 2**31 - 1)
    low, high = sorted((start, end))
    return F.substring(value, low + 1, high - low)


class Compiler:
    """Compiles templates against the columns of a connection row, or of a stop row.

    `columns` maps the roots to struct columns: connection's own fields to their columns
    in a dict, trips, routes and stops to a struct. Fields a table doesn't have are empty.
    """

    def __init__(self, templates: Templates, timezone: str = "UTC"):
        self.templates, self.timezone = templates, timezone

    def fill(self, template: str, roots: dict[str, object]) -> Column:
        pieces: list[Column] = []
        for text, name in re.findall(r"([^{}]+)|\{([^{}]*)\}", template):
            pieces.append(F.lit(text) if text else encode(self.variable(name, roots)))
        return F.concat(*pieces) if pieces else F.lit("")

    def variable(self, name: str, roots: dict[str, object]) -> Column:
        """A place's value: its resolver's, else a table's column; instants need a date pattern, stops stand for their ids."""
        if name in self.templates.resolve:
            return self.resolver(self.templates.resolve[name], roots)
        table, _, rest = name.partition(".")
        column = rest.partition(".")[0]
        plain, _, pattern = column.partition("(")
        for stem, kind in SPECIAL.get(table, {}).items():
            if not plain.startswith(stem):
                continue
            if kind == "stop":
                return self.path([table, stem, "stop_id"], roots)
            if not pattern.endswith(")"):
                raise ValueError(f"No date pattern in {{{name}}}")
            return local_text(self.path([table, stem], roots), self.timezone, java_pattern(pattern[:-1]))
        return self.path([table, column], roots)

    def resolver(self, expression: str, roots: dict[str, object]) -> Column:
        """A resolver's value, if its tokens are those of one of the three forms."""
        form = _scan(expression)
        match form:
            case ["format", "(", list(path), ",", str(text), ")"] if text[0] in "'\"":
                return local_text(self.path(path, roots), self.timezone, java_pattern(text[1:-1]))
            case [list([*path, "substring"]), "(", int(start), ")"] if len(path) > 1:
                return substring(self.path(path, roots).cast("string"), start, None)
            case [list([*path, "substring"]), "(", int(start), ",", int(end), ")"] if len(path) > 1:
                return substring(self.path(path, roots).cast("string"), start, end)
            case [list(path)]:
                return self.path(path, roots)
        raise ValueError(f"Unsupported base URI resolver expression: {expression}")

    @staticmethod
    def path(names: list[str], roots: dict[str, object]) -> Column:
        at = roots.get(ROOTS.get(names[0], ""))
        for name in names[1:]:
            at = at.get(name) if isinstance(at, dict) else None
        return at if isinstance(at, Column) else F.lit(None).cast("string")


#: Columns that aren't given as they are: instants by a pattern, stops by their id.
SPECIAL = {"trips": {"startTime": "time", "departureTime": "time", "arrivalTime": "time"}, "connection": {"startTime": "time", "departureTime": "time", "arrivalTime": "time", "departureStop": "stop", "arrivalStop": "stop"}}


def _scan(expression: str) -> list | None:
    """An expression's tokens: dotted names from a table as lists, numbers, quoted texts and signs; None where anything else occurs."""
    tokens, rest = [], expression.strip().removesuffix(";").strip()
    while rest:
        if rest[0] in "(),":
            tokens.append(rest[0])
            rest = rest[1:]
        elif rest[0] in "'\"":
            end = rest.find(rest[0], 1)
            if end < 0:
                return None
            tokens.append(rest[: end + 1])
            rest = rest[end + 1 :]
        else:
            word = rest[: next((i for i, c in enumerate(rest) if not (c.isalnum() and c.isascii() or c in "_$.")), len(rest))]
            names = word.split(".")
            if word.isdigit():
                tokens.append(int(word))
            elif word == "format":
                tokens.append(word)
            elif len(names) > 1 and names[0] in ROOTS and all(n and not n[0].isdigit() for n in names):
                tokens.append(names)
            else:
                return None
            rest = rest[len(word) :]
        rest = rest.lstrip()
    return tokens


def row_roots(df) -> dict[str, object]:
    """The roots of a connections DataFrame, from its actual columns."""
    from pyspark.sql import types as T

    def tree(schema: T.StructType, prefix: str) -> dict[str, object]:
        return {f.name: tree(f.dataType, f"{prefix}`{f.name}`.") if isinstance(f.dataType, T.StructType) else F.col(f"{prefix}`{f.name}`") for f in schema.fields}

    own = tree(df.schema, "")
    return {"connection": own, "trip": own.get("trip"), "route": own.get("route")}


def uri_columns(df, templates: Templates, timezone: str = "UTC") -> dict[str, Column]:
    """The `@id`, stops, trip and route of each connection as URI columns."""
    compiler, roots = Compiler(templates, timezone), row_roots(df)
    connection = roots["connection"]
    stop = lambda side: compiler.fill(templates.stop, {"stop": connection[side], "connection": connection[side]})
    return {
        "@id": compiler.fill(templates.connection, roots), "departureStop": stop("departureStop"), "arrivalStop": stop("arrivalStop"),
        "gtfs:trip": compiler.fill(templates.trip, roots), "gtfs:route": compiler.fill(templates.route, roots),
    }
