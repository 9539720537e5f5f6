"""Rows that fail to parse: set aside with the reason, while the valid ones load.

Every record goes through one dynamic program that parses it at minimum cost: over its
characters, with a state for where in a field it is and the number of fields finished;
quotes and delimiters may be inserted or deleted at cost 1. It runs for whole Arrow
batches at once, first within cost 0, where the states are few and the number of fields
is free, then in full for the records that cost something. What it finds states the
reason: `quoting` where no parse is free, `column_count` where one is but not with the
declared number of fields, else the names of the fields whose values would have to be
replaced, each at cost 1 too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.text import or_empty, strip

# The columns of the two kinds of delivered files.
FILES = {
    "stop_times.txt": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "stop_headsign", "pickup_type", "drop_off_type", "shape_dist_traveled"),
    "calendar.txt": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
}

#: One field of a well-formed record with the comma before it; a comma is put in front of the record.
_EACH = r'(?s),("(?:[^"]++|"")*+"|[^",]*+)'
_START, _BARE, _QUOTED, _CLOSED, _DEAD = range(5)
_QUOTE, _COMMA, _OTHER = range(3)
#: The free moves: by state and sign, the next state.
_FREE = np.array([[_QUOTED, _START, _BARE], [_DEAD, _START, _BARE], [_CLOSED, _QUOTED, _QUOTED], [_QUOTED, _START, _DEAD], [_DEAD] * 3], dtype=np.int8)
_ENDS = (_START, _BARE, _CLOSED)
#: Cells of one block of records; longer records stand in blocks of their own.
_CELLS = 4_000_000


def good_sequence(c: Column) -> Column:
    """ASCII digits only, at most 2147483647; blank is not good."""
    v = or_empty(strip(c))
    number = F.regexp_extract(v, r"\A0*([0-9]{1,10})\z", 1).try_cast("bigint")
    return F.coalesce(number <= 2147483647, F.lit(False))


def good_pickup(c: Column) -> Column:
    """Blank or exactly 0, 1, 2 or 3."""
    return or_empty(strip(c)).isin("", "0", "1", "2", "3")


def good_day(c: Column) -> Column:
    """Eight ASCII digits naming a real day as yyyyMMdd."""
    v = or_empty(strip(c))
    iso = F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2))
    return v.rlike(r"\A[0-9]{8}\z") & iso.try_cast("date").isNotNull()


CHECKS = {"stop_sequence": good_sequence, "pickup_type": good_pickup, "start_date": good_day}


def record(raw: Column | str) -> Column:
    """The record without its final carriage return."""
    return F.regexp_replace(raw, r"\r\z", "")


def split_record(rec: Column) -> Column:
    """The fields of a well-formed record, unquoted, as an array."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), rec), F.lit(_EACH), F.lit(1))
    bare = lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(fields, bare)


def _blocks(records: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, lengths, signs by place and record) of records in blocks of like length, the longest first."""
    sizes = np.array([len(r) for r in records], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    classes = np.full(256, _OTHER, dtype=np.int8)
    classes[ord('"')], classes[ord(",")] = _QUOTE, _COMMA
    at = 0
    while at < len(order):
        width = max(1, int(sizes[order[at]]))
        rows = order[at : at + max(1, _CELLS // width)]
        signs = np.array([records[i] for i in rows], dtype=f"S{width}").view(np.uint8).reshape(len(rows), width)
        yield rows, sizes[rows], classes[signs].T.copy()
        at += len(rows)


def free_parses(records: list[bytes]) -> np.ndarray:
    """The number of fields of each record's parse at cost 0, 0 where it has none."""
    found = np.zeros(len(records), dtype=np.int64)
    for rows, sizes, signs in _blocks(records):
        state, fields = np.zeros(len(rows), dtype=np.int8), np.ones(len(rows), dtype=np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, len(signs) + 1), side="right")  # records still running at each place
        for place, n in enumerate(active):
            sign, now = signs[place, :n], state[:n]
            fields[:n] += (sign == _COMMA) & (now != _QUOTED)
            state[:n] = _FREE[now, sign]
        found[rows] = np.where(np.isin(state, _ENDS), fields, 0)
    return found


def repairs(records: list[bytes], fields: int) -> list[tuple[int, str]]:
    """(cost, edits) of the cheapest repair of each record to `fields` fields.

    `edits` counts them by kind. Of repairs of equal cost the one with the fewest
    inserted quotes counts, then inserted delimiters, then deleted quotes.
    """
    out: list[tuple[int, str]] = [(0, "")] * len(records)
    for rows, sizes, signs in _blocks(records):
        # A cell is one number: the cost, then the edits of three kinds; records too long for that get Python's own numbers.
        bits, kind = (15, np.int64) if len(signs) + fields < 1 << 15 else (40, object)
        one = 1 << 3 * bits
        put_quote, put_comma, drop_quote, drop_comma = one + (1 << 2 * bits), one + (1 << bits), one + 1, one
        far = one << 16 if kind is np.int64 else one << 60
        cells = np.full((4, fields, len(rows)), far, dtype=kind)
        cells[_START, 0] = 0

        def insert(c: np.ndarray) -> None:
            """Insertions before the next sign, from the first field on."""
            for f in range(fields):
                np.minimum(c[_QUOTED, f], c[_START, f] + put_quote, out=c[_QUOTED, f])
                np.minimum(c[_CLOSED, f], c[_QUOTED, f] + put_quote, out=c[_CLOSED, f])
                if f + 1 < fields:
                    done = np.minimum(np.minimum(c[_START, f], c[_BARE, f]), c[_CLOSED, f])
                    np.minimum(c[_START, f + 1], done + put_comma, out=c[_START, f + 1])

        for place in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -(place + 1), side="right"))
            now = cells[:, :, :n]
            insert(now)
            new = np.full_like(now, far)
            for sign in (_QUOTE, _COMMA, _OTHER):
                those = np.flatnonzero(signs[place, :n] == sign)
                if not len(those):
                    continue
                c = now[:, :, those]
                if sign == _QUOTE:
                    made = c + drop_quote
                    made[_QUOTED] = np.minimum(made[_QUOTED], np.minimum(c[_START], c[_CLOSED]))
                    made[_CLOSED] = np.minimum(made[_CLOSED], c[_QUOTED])
                elif sign == _COMMA:
                    made = c + drop_comma
                    made[_QUOTED] = c[_QUOTED]
                    done = np.minimum(np.minimum(c[_START], c[_BARE]), c[_CLOSED])
                    made[_START, 1:] = np.minimum(made[_START, 1:], done[:-1])
                else:
                    made = np.full_like(c, far)
                    made[_BARE] = np.minimum(c[_START], c[_BARE])
                    made[_QUOTED] = c[_QUOTED]
                new[:, :, those] = np.minimum(made, far)
            cells[:, :, :n] = new
        insert(cells)
        best = np.minimum(np.minimum(cells[_START, -1], cells[_BARE, -1]), cells[_CLOSED, -1])
        for row, value in zip(rows, best, strict=True):
            value, mask = int(value), (1 << bits) - 1
            cost, counts = value >> 3 * bits, [value >> 2 * bits & mask, value >> bits & mask, value & mask]
            counts.append(cost - sum(counts))
            names = ("insert_quote", "insert_delimiter", "delete_quote", "delete_delimiter")
            out[row] = cost, " ".join(f"{k}:{v}" for k, v in zip(names, counts, strict=True) if v)
    return out


def repair(text: str, fields: int) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of one record."""
    return repairs([text.encode()], fields)[0]


def _programme(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        records = [r.encode() if isinstance(r, str) else b"" for r in batch["_rec"]]
        want = batch["_want"].to_numpy()
        free = free_parses(records)
        cost, edits = np.zeros(len(records), dtype=np.int64), np.full(len(records), "", dtype=object)
        for fields in np.unique(want):
            rows = np.flatnonzero((want == fields) & (free != fields))
            for row, (c, e) in zip(rows, repairs([records[i] for i in rows], int(fields)), strict=True):
                cost[row], edits[row] = c, e
        yield batch.assign(_free=free, cost=cost.astype("int32"), edits=edits)


def parse_records(raw: DataFrame, keep: list[str], file_name: str = "file_name", line_no: str = "line_no", text: str = "raw") -> DataFrame:
    """(*keep, file_name, _rec, _want, _free, cost, edits, _shape, _fields) of `raw` without headers.

    `_shape` is quoting, column_count or NULL; `_fields` are the fields of records
    without a `_shape`. A NULL record, and a record of an unknown file, have the wrong
    number of columns.
    """
    want = F.create_map(*[F.lit(x) for f, cols in FILES.items() for x in (f, len(cols))])
    rows = raw.where(~F.col(line_no).eqNullSafe(F.lit(1))).select(*keep, F.col(file_name).alias("_file"), record(text).alias("_rec"), F.coalesce(F.try_element_at(want, F.col(file_name)), F.lit(1)).alias("_want"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    parsed = rows.mapInPandas(_programme, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", _free bigint, cost int, edits string")
    odd = F.col("_rec").isNull() | ~F.coalesce(F.col("_file").isin(*FILES), F.lit(False))
    shape = F.when(odd, "column_count").when(F.col("_free") == 0, "quoting").when(F.col("cost") > 0, "column_count")
    parsed = parsed.withColumn("_shape", shape)
    return parsed.withColumn("_fields", F.when(F.col("_shape").isNull(), split_record(F.col("_rec"))))


def rejected_records(raw: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, reason, cost, edits): a row per reason of each record set aside.

    A record that parses at cost 0 but has values of the wrong type costs a
    replacement for each.
    """
    rows = parse_records(raw, keep)
    bad = F.array(
        *[
            F.when((F.col("_file") == f) & ~check(F.get("_fields", F.lit(cols.index(c)))), F.lit(c))
            for f, cols in FILES.items()
            for c, check in CHECKS.items()
            if c in cols
        ]
    )
    values = F.filter(bad, lambda c: c.isNotNull())
    reasons = F.when(F.col("_shape").isNotNull(), F.array("_shape")).otherwise(values)
    replaced = F.size("_reasons")
    free = F.col("_shape").isNull()
    return rows.withColumn("_reasons", reasons).where(F.size("_reasons") > 0).select(
        *keep, F.explode("_reasons").alias("reason"), F.when(free, replaced).otherwise(F.col("cost")).alias("cost"),
        F.when(free, F.concat(F.lit("replace_value:"), replaced.cast("string"))).otherwise(F.col("edits")).alias("edits"),
    )


def loaded_records(raw: DataFrame, file_name: str, keep: list[str]) -> DataFrame:
    """The good records of one kind of file, with their columns; numbers and days typed."""
    cols = FILES[file_name]
    rows = parse_records(raw.where(F.col("file_name") == file_name), keep).where(F.col("_shape").isNull())
    good = F.lit(True)
    for c, check in CHECKS.items():
        if c in cols:
            good = good & check(F.get("_fields", F.lit(cols.index(c))))
    out = rows.where(good).select(*[F.col(k).alias(k) for k in keep], *[strip(F.get("_fields", F.lit(i))).alias(c) for i, c in enumerate(cols)])
    if "stop_sequence" in cols:
        out = out.withColumn("stop_sequence", F.col("stop_sequence").cast("int"))
    if "start_date" in cols:
        out = out.withColumn("start_date", F.to_date("start_date", "yyyyMMdd"))
    return out


def rejected_values(df: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """(*keep, reason): a row per bad field of the rows of a loaded table."""
    bad = F.array(*[F.when(~CHECKS[c](F.col(c)), F.lit(c)) for c in fields])
    return df.select(*keep, F.explode(F.filter(bad, lambda c: c.isNotNull())).alias("reason"))
