"""RDF messages as delimited binary frames of the public Jelly protocol, one frame per message.

Every frame carries its own lookup entries, so frames can be written by any task in any
order and files can be joined byte by byte; the options row stands in the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Field numbers of the protocol's messages.
ROW = {"options": 1, "triple": 2, "namespace": 6, "name": 9, "prefix": 10, "datatype": 11}
TERM = {"s": 1, "p": 5, "o_iri": 9, "o_literal": 11}
NAMES, PREFIXES, DATATYPES = 128, 16, 16


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n) if n else b""


def block(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def options() -> bytes:
    """The stream's options: triples, table sizes, flat logical type, version 2, the first with namespaces."""
    body = number(2, 1) + number(9, NAMES) + number(10, PREFIXES) + number(11, DATATYPES) + number(14, 1) + number(15, 2)
    return block(1, block(ROW["options"], body))


def _split(iri: str) -> tuple[str, str]:
    cut = max(iri.rfind("#"), iri.rfind("/")) + 1
    return iri[:cut], iri[cut:]


def frame(quads: Iterable[dict], first: bool = False) -> bytes:
    """A message's frame without its length."""
    rows: list[bytes] = [options()] if first else []
    tables: dict[str, dict[str, int]] = {"prefix": {}, "name": {}, "datatype": {}}

    def entry(kind: str, value: str) -> int:
        known = tables[kind]
        if value not in known:
            known[value] = len(known) + 1
            rows.append(block(1, block(ROW[kind], number(1, known[value]) + block(2, value.encode()))))
        return known[value]

    def iri(value: str) -> bytes:
        prefix, name = _split(value)
        return number(1, entry("prefix", prefix)) + number(2, entry("name", name))

    for q in quads:
        s, p = block(TERM["s"], iri(q["s"])), block(TERM["p"], iri(q["p"]))
        if q["kind"] == "iri":
            o = block(TERM["o_iri"], iri(q["o"]))
        else:
            o = block(TERM["o_literal"], block(1, q["o"].encode()) + number(3, entry("datatype", q["datatype"])))
        rows.append(block(1, block(ROW["triple"], s + p + o)))
    return b"".join(rows)


def namespaces(names: dict[str, str]) -> bytes:
    """The frame that a file begins with: options and namespace declarations, no triple."""
    rows = [options()]
    for i, (name, iri) in enumerate(names.items(), 1):
        prefix, rest = _split(iri)
        rows += [block(1, block(ROW["prefix"], number(1, i) + block(2, prefix.encode()))), block(1, block(ROW["name"], number(1, i) + block(2, rest.encode())))]
        rows.append(block(1, block(ROW["namespace"], block(1, name.encode()) + block(2, number(1, i) + number(2, i)))))
    return b"".join(rows)


def delimited(body: bytes) -> bytes:
    return varint(len(body)) + body


def to_jelly_rows(quad_rows: DataFrame) -> DataFrame:
    """(value binary): each message as a delimited frame with its own options."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [delimited(frame(q, first=True)) for q in batch["_quads"]]})

    return quad_rows.select("_quads").mapInPandas(run, "value binary")


def read_frames(data: bytes) -> list[list[tuple[str, str, str, str | None]]]:
    """The triples of each frame that has any, as (s, p, o, datatype); literals have a datatype."""

    def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0

        def take() -> int:
            nonlocal i
            n = shift = 0
            while True:
                byte = b[i]
                i += 1
                n |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    return n

        while i < len(b):
            tag = take()
            if tag & 7 == 0:
                yield tag >> 3, take()
            else:
                size = take()
                yield tag >> 3, b[i : i + size]
                i += size

    frames, i = [], 0
    tables: dict[int, dict[int, str]] = {9: {}, 10: {}, 11: {}}
    while i < len(data):
        size = shift = 0
        while True:
            byte = data[i]
            i += 1
            size |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
        body, triples = data[i : i + size], []
        i += size
        for _, row in fields(body):
            for kind, value in fields(row):
                got = dict(fields(value))
                if kind in tables:
                    tables[kind][got[1]] = got[2].decode()
                elif kind == ROW["triple"]:
                    iri = lambda v: (lambda f: tables[10][f[1]] + tables[9].get(f.get(2, 0), ""))(dict(fields(v)))
                    if TERM["o_iri"] in got:
                        triples.append((iri(got[1]), iri(got[5]), iri(got[9]), None))
                    else:
                        literal = dict(fields(got[11]))
                        triples.append((iri(got[1]), iri(got[5]), literal.get(1, b"").decode(), tables[11][literal[3]]))
        if triples:
            frames.append(triples)
    return frames
