"""Evaluation passages inside training pages.

Normalised n-grams of the passages form a broadcast hash set; every page's token
windows are looked up in it, one is followed both ways, and runs are verified by aligning the page's words, in
printed order, with the passage's. The alignment follows words across line ends and
may skip whole lines (adverts, neighbouring columns), never words within a line.
"""

from __future__ import annotations

import gc
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.pages import BREAKS, WORD, fold, joined, printed_lines

#: Consecutive words of a passage that make a leak.
RUN = 12
#: Words of the hashed windows.
NGRAM = 3
#: Characters of passages that one broadcast holds. Measured, their index takes 360 MB in a Python worker; more passages go in several passes.
BLOCK_CHARS = 4_000_000
#: Page words whose meanings a worker remembers.
REMEMBERED = 200_000

_DIGIT = re.compile("[0-9]")
_NOTHING: frozenset[int] = frozenset()
_UNKNOWN = -(1 << 60)


def _shortened(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out."""
    out = new = {word}
    for _ in range(most):
        new = {w[:i] + w[i + 1 :] for w in new for i in range(len(w))}
        out = out | new
    return out


class Passages:
    """Hash index of the passages' windows, and of the words that page words may stand for.

    Passages that fold alike are held once. Words are numbers; a window is one number
    made of three.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        groups: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, passage in rows:
            words = tuple(WORD.findall(fold(passage)))
            if len(words) >= RUN:
                groups[words].append(item)
        self.words = list(groups)
        self.items = list(groups.values())
        self.vocabulary: dict[str, int] = {}
        for words in self.words:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.meant = list(self.vocabulary)
        self.numbers = [array("i", (self.vocabulary[w] for w in words)) for words in self.words]
        self.size = len(self.vocabulary)
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, numbers in enumerate(self.numbers):
            for i, (a, b, c) in enumerate(zip(numbers, numbers[1:], numbers[2:])):
                self.grams[(a * self.size + b) * self.size + c].append((k, i))
        self._near: dict[str, list[int]] = defaultdict(list)
        for w, number in self.vocabulary.items():
            if len(w) >= 3 and not _DIGIT.search(w):
                for short in _shortened(w, 1 if len(w) < 7 else 2):
                    self._near[short].append(number)
        self.known: dict[str, frozenset[int]] = {}

    def numbered(self, words: list[str]) -> list[int]:
        """The words' numbers; the unknown get one that makes no window."""
        return list(map(self.vocabulary.get, words, repeat(_UNKNOWN)))

    def hits(self, numbers: Sequence[int]) -> list[tuple[int, list[tuple[int, int]]]]:
        """(place, (passage, place in it) …) of the windows that passages have."""
        n, known = self.size, self.grams.get
        keys = [(a * n + b) * n + c for a, b, c in zip(numbers, numbers[1:], numbers[2:])]
        return [(j, found) for j, found in enumerate(map(known, keys)) if found is not None]

    def meanings(self, seen: str) -> frozenset[int]:
        """The numbers of all words of passages that a folded word may be a misreading of (`same_word`)."""
        known = self.known.get(seen)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = {self.vocabulary[seen]} if seen in self.vocabulary else set()
            if not _DIGIT.search(seen) and len(seen) < 40:
                found.update(n for short in _shortened(seen, 2 if len(seen) > 4 else 1) for n in self._near.get(short, ()) if n not in found and same_word(seen, self.meant[n]))
            elif not _DIGIT.search(seen):
                found.update(n for w, n in self.vocabulary.items() if same_word(seen, w))
            known = self.known[seen] = frozenset(found) if found else _NOTHING
        return known


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, at most `most + 1`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(1 << 16)
def same_word(seen: str, meant: str) -> bool:
    """Whether a folded word can be a misreading of another. Numbers must fold alike."""
    if seen == meant:
        return True
    most = 1 if len(meant) < 7 else 2
    if len(meant) < 3 or abs(len(seen) - len(meant)) > most or _DIGIT.search(seen) or _DIGIT.search(meant):
        return False
    return len(set(seen) ^ set(meant)) <= 2 * most and _distance(seen, meant, most) <= most


@lru_cache(1 << 16)
def part_of(piece: str, meant: str, head: bool) -> bool:
    """Whether a folded piece of a broken word can be the head, or else the tail, of a misreading of a word."""
    most = 1 if len(meant) < 7 else 2
    if len(piece) <= most:
        return True
    if len(piece) > len(meant) + most:
        return False
    if not head:
        piece, meant = piece[::-1], meant[::-1]
    if meant.startswith(piece):
        return True
    # One table for all lengths of the word's part: row j is the distance of the piece's first letters to the part of j letters.
    row = list(range(len(piece) + 1))
    for j, y in enumerate(meant[: len(piece) + most], 1):
        last, row[0] = row[0], j
        least = j
        for i, x in enumerate(piece, 1):
            here = last if x == y else 1 + (last if last < row[i] else row[i])
            if row[i - 1] < here - 1:
                here = row[i - 1] + 1
            last, row[i] = row[i], here
            if here < least:
                least = here
        if row[-1] <= most:
            return True
        if least > most:
            return False
    return False


def longest_run(lines: list[str], passage: tuple[str, ...]) -> tuple[int, int, int]:
    """(words, first line, last line) of the longest run of the passage's words on a page.

    The page's lines come in printed order. A step goes to the next word, or from the
    last word of a line to the first of any later line; a word broken
    at a line's end goes on at such a first word.
    """
    words: list[str] = []
    line_of: list[int] = []
    firsts: list[int] = []
    lasts: list[int] = []
    broken: set[int] = set()
    for raw in lines:
        found = WORD.findall(fold(raw))
        if not found:
            continue
        firsts.append(len(words))
        words += found
        lasts.append(len(words) - 1)
        line_of += [len(firsts) - 1] * len(found)
        if raw.rstrip()[-1:] and raw.rstrip()[-1] in BREAKS:
            broken.add(len(words) - 1)
    spots: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(passage):
        spots[w].append(i)
    first_set = {j: k for k, j in enumerate(firsts)}
    m = len(passage)
    # chains[j][i] = (length, start) of the longest run whose word i of the passage ends at page word j
    chains: list[dict[int, tuple[int, int, int]]] = []
    best = (0, 0, 0, 0, 0)  # length, first passage word, first page word, last page word, last passage word

    def before(j: int) -> list[int]:
        k = first_set.get(j)
        if k is None:
            return [j - 1]
        return [lasts[b] for b in range(k - 1, -1, -1)]

    for j, word in enumerate(words):
        here: dict[int, tuple[int, int, int]] = {i: (1, i, j) for i in spots.get(word, ())}
        k = first_set.get(j)
        for p in before(j):
            if p < 0 or p >= j:
                continue
            for i, (length, i0, j0) in chains[p].items():
                if i + 1 < m and here.get(i + 1, (0,))[0] <= length and (i + 1 in here or length >= 2 and same_word(word, passage[i + 1])):
                    here[i + 1] = (length + 1, i0, j0)
            if k is not None and p in broken:
                whole = words[p] + word
                sources = chains[p - 1].items() if p - 1 >= 0 and p not in first_set else ()
                if p in first_set:
                    sources = [x for q in before(p) if 0 <= q < p for x in chains[q].items()]
                for i in spots.get(whole, ()):
                    if i not in here:
                        here[i] = (1, i, j)
                for i, (length, i0, j0) in sources:
                    if i + 1 < m and here.get(i + 1, (0,))[0] <= length and same_word(whole, passage[i + 1]):
                        here[i + 1] = (length + 1, i0, j0)
        chains.append(here)
        for i, (length, i0, j0) in here.items():
            if length > best[0]:
                best = (length, i0, j0, j, i)
    length, i, j, end, _ = best
    while 2 <= length < RUN <= length + i and i > 0:  # the run's first words may themselves be misread
        step = next((p for p in before(j) if 0 <= p < j and (same_word(words[p], passage[i - 1]) or words[p] == passage[i - 1])), None)
        if step is None:
            break
        length, i, j = length + 1, i - 1, step
    return (length, line_of[j], line_of[end]) if words else (0, 0, 0)


def scan_page(text: str, x0: list[int] | None, y0: list[int] | None, index: Passages) -> list[tuple[int, int, int, int]]:
    """(item, words, first line, last line) of each passage that a page contains."""
    lines = printed_lines(text, x0, y0)
    page = _Words(lines, index)
    opened: set[int] = set()
    failed: set[tuple[int, int]] = set()
    numbers, last = index.numbers, -2
    for j, hits in index.hits(index.numbered(page.words)):
        # A run needs a next word on one side at least; inside a line that is the neighbour.
        right_open, right = page.neighbour(j + NGRAM - 1, 1)
        left_open, left = page.neighbour(j, -1)
        if not (right_open or left_open or right or left):
            continue
        # What failed one word before fails here too, unless a line begins here.
        before, failed = (failed if last == j - 1 and j not in page.firsts else ()), set()
        last = j
        for k, i in hits:
            if k in opened:
                continue
            if not before or (k, i - 1) not in before:
                passage = numbers[k]
                after = len(passage) - i - NGRAM
                ahead = after > 0 and (passage[i + NGRAM] in right or right_open and page.may_cross(j + NGRAM - 1, 1, passage[i + NGRAM], passage[i + NGRAM + 1] if after > 1 else -1))
                back = i > 0 and (passage[i - 1] in left or left_open and page.may_cross(j, -1, passage[i - 1], passage[i - 2] if i > 1 else -1))
                if NGRAM + (after if ahead else 0) + (i if back else 0) >= RUN and page.may_run(k, i, j, ahead, back):
                    opened.add(k)
                    continue
            failed.add((k, i))
    out = []
    for k in sorted(opened):
        length, first, last = longest_run(lines, index.words[k])
        if length >= RUN:
            out += [(item, length, first, last) for item in index.items[k]]
    return out


class _Words:
    """A page's words with broken ones put together, what they may stand for, and where lines begin and end among them."""

    def __init__(self, lines: list[str], index: Passages):
        self.index = index
        self.words: list[str] = []
        words, starts, head = self.words, [], None
        self.broken: dict[int, tuple[str, str]] = {}
        for raw, folded in zip(lines, fold("\n".join(lines)).split("\n"), strict=True):
            found = WORD.findall(folded)
            if not found:
                continue
            if head is None:
                starts.append(len(words))
                words += found
            else:  # put together before folding, since letters at the break may fold as one
                self.broken[len(words) - 1] = (words[-1], found[0])
                words[-1] = WORD.findall(fold(head + WORD.search(raw).group()))[0]
                words += found[1:]
            tail = raw.rstrip()
            head = WORD.findall(raw)[-1] if tail[-1] in BREAKS and tail[-2:-1].isalnum() else None
        if head is not None:
            self.broken[len(words) - 1] = (words[-1], "")
        self.firsts = {*starts, *self.broken}
        self.ends = {j - 1 for j in starts} | {len(words) - 1} | set(self.broken)
        self.meanings: list[frozenset[int] | None] = list(map(index.known.get, words))
        self.loose: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        self.found: dict[tuple[int, int, int], list[int]] = {}
        self.pieces: dict[int, bool] = {}
        self.edges: dict[int, tuple[dict[int, list[tuple[int, frozenset[int]]]], set[int], set[int]]] = {}
        #: Whether a broken word stands in a line of its own.
        self.odd = any(q - 1 in self.broken or q + 1 in self.broken for q in self.broken)

    def in_pieces(self, number: int) -> bool:
        """Whether a word may stand on the page broken, its pieces at any lines, or as a piece of what looks broken."""
        known = self.pieces.get(number)
        if known is None:
            meant = self.index.meant[number]
            known = self.pieces[number] = any(part_of(head, meant, True) or same_word(tail, meant) for head, tail in self.broken.values())
        return known

    def neighbour(self, p: int, step: int) -> tuple[bool, frozenset[int]]:
        """Whether a run may go on from p elsewhere than at its neighbour, or there in pieces; and the words the neighbour may stand for."""
        q = p + step
        wide = p in (self.ends if step > 0 else self.firsts) or q in self.broken or step < 0 and bool(self.broken) and q in self.firsts
        return wide, self._means(q) if 0 <= q < len(self.words) else _NOTHING

    def may_cross(self, p: int, step: int, one: int, two: int) -> bool:
        """Whether the next two words of a run (`two` -1 at the passage's end) may follow at any other line, or the first of them in pieces.

        It looks one word further than the jump itself, which settles nearly all cases met by chance.
        """
        beginnings, alone, beyond = self.edges.get(step) or self._edge(step)
        if one in alone or one in beginnings and any(two in after for _, after in beginnings[one]):
            return True
        if two < 0 or self.odd:
            return bool(self._at_lines(one, 0, step)) or bool(self.broken) and (self.in_pieces(one) or one in beyond)
        return bool(self.broken) and (one in beyond and p in self.broken or two in beyond and self.in_pieces(one))

    def may_run(self, k: int, i: int, j: int, ahead: bool = True, back: bool = True) -> bool:
        """Whether a run of `RUN` words may go through the window at i of a passage and j of the page, `ahead` or `back` of it.

        It goes on with the next word or, at a line's end, at any other line in the direction;
        a word broken at a line's end may go on at any other line too. Wider than `longest_run`, which decides.
        """
        passage = self.index.numbers[k]
        n = NGRAM + (self._follow(passage, i + NGRAM - 1, j + NGRAM - 1, 1, RUN - NGRAM) if ahead else 0)
        return n >= RUN or back and i >= RUN - n and n + self._follow(passage, i, j, -1, RUN - n) >= RUN

    def _edge(self, step: int) -> tuple[dict[int, list[tuple[int, frozenset[int]]]], set[int], set[int]]:
        """Of the firsts of lines (ends, going back): by what they may stand for, each with what its neighbour may; those that the neighbour doesn't settle; all that neighbours may stand for."""
        beginnings, alone, beyond, size = {}, set(), set(), len(self.words)
        places, others = (self.firsts, self.ends) if step > 0 else (self.ends, self.firsts)
        known, broken = self.meanings, self.broken
        for q in places:
            here, r = known[q], q + step
            if here is None:
                here = self._means(q)
            inside = 0 <= r < size
            after = known[r] if inside else _NOTHING
            if after is None:
                after = self._means(r)
            if broken and after:
                beyond |= after
            if here:
                if not inside or q in others or r in broken or step < 0 and r in self.firsts:
                    alone |= here
                for a in here:
                    if a in beginnings:
                        beginnings[a].append((q, after))
                    else:
                        beginnings[a] = [(q, after)]
        self.edges[step] = made = (beginnings, alone, beyond)
        return made

    def _means(self, q: int) -> frozenset[int]:
        known = self.meanings[q]
        if known is None:
            known = self.meanings[q] = self.index.meanings(self.words[q])
        return known

    def _stands_for(self, q: int, number: int, step: int) -> bool:
        if number in self._means(q):
            return True
        # Going back, a word may end in a first word whose head is at another line's end.
        at_tail = step < 0 and q in self.firsts
        if not self.broken or not (at_tail or q in self.broken) or not self.in_pieces(number):
            return False
        meant = self.index.meant[number]
        head, tail = self.broken.get(q, ("", ""))
        if head and (part_of(head, meant, True) or same_word(tail, meant) or part_of(tail, meant, False)):
            return True
        return at_tail and len(self.words[q]) < len(meant) and part_of(self.words[q], meant, False)

    def _places(self, shift: int, step: int) -> tuple[list[int], list[int]]:
        """Firsts of lines (ends, going back), or with `shift` their neighbours; and those of them that show only in parts what they may stand for."""
        made = self.loose.get((shift, step))
        if made is None:
            size = len(self.words)
            at = [q + shift * step for q in (self.firsts if step > 0 else self.ends) if 0 <= q + shift * step < size]
            made = self.loose[shift, step] = at, [q for q in at if q in self.broken or step < 0 and q in self.firsts]
        return made

    def _at_lines(self, number: int, shift: int, step: int) -> Sequence[int]:
        """Firsts of lines (ends, going back), or with `shift` their neighbours, that may stand for a word."""
        found = self.found.get((number, shift, step))
        if found is None:
            if shift == 0:
                found = [q for q, _ in (self.edges.get(step) or self._edge(step))[0].get(number, ())]
            else:
                found = [q for q in self._places(shift, step)[0] if number in self._means(q)]
            if self.broken and self.in_pieces(number):
                found = [*found, *(q for q in self._places(shift, step)[1] if self._stands_for(q, number, step))]
            self.found[number, shift, step] = found
        return found

    def _follow(self, passage: Sequence[int], i: int, j: int, step: int, most: int) -> int:
        n, size, known = 0, len(self.words), self.meanings
        line_ends = self.ends if step > 0 else self.firsts
        tails = self.firsts if step < 0 and self.broken else ()
        # Inside a line there is one way on.
        while n < most and 0 <= i + step < len(passage) and j not in line_ends:
            q = j + step
            if q in self.broken or q in tails:
                break
            if passage[i + step] not in (known[q] if known[q] is not None else self._means(q)):
                return n
            i, j, n = i + step, q, n + 1
        places = {j}
        while n < most and 0 <= i + step < len(passage):
            i += step
            number = passage[i]
            after = {p + step for p in places if 0 <= p + step < size and self._stands_for(p + step, number, step)}
            jumps = [p for p in places if p in line_ends]
            if jumps:
                bound = min(jumps) if step > 0 else max(jumps)
                after.update(q for q in self._at_lines(number, 0, step) if (q > bound if step > 0 else q < bound))
            cut = [p for p in jumps if p in self.broken] if jumps else ()
            if cut:  # the other piece was passed with the word
                bound = min(cut) if step > 0 else max(cut)
                after.update(q for q in self._at_lines(number, 1, step) if (q - step > bound if step > 0 else q - step < bound))
            if not after:
                break
            places = after
            n += 1
        return n


#: The index a worker holds, and of which passages; workers outlive tasks.
_HELD: dict[str, object] = {"key": None, "index": None}


def _index_of(key: str, rows: list[tuple[int, str]]) -> Passages:
    if _HELD["key"] != key:
        _HELD.update(key=key, index=Passages(rows))
        gc.freeze()  # it stays; the collector needn't look through it
    return _HELD["index"]


def _lists(column: pa.ListArray) -> list[list[int] | None]:
    """The lists of a column as Python's; a missing number in one comes as NaN."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist()
    return [values[a:b] if there else None for a, b, there in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)]


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, words, first_line, last_line), a row per page and item found in it.

    `items` has item_id and passage. Passages are broadcast in blocks of at most
    `block_chars` characters each, so the broadcast is bounded whatever their number.
    Pages without text contain nothing, neither do passages of fewer than `RUN` words.
    Pages without boxes, or whose boxes don't match their lines, are read as they come.
    """
    spark = documents.sparkSession
    usable = items.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "passage")
    total = usable.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    pages = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.col("lines.x0").alias("x0"), F.col("lines.y0").alias("y0"))
    found = None
    for b in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else usable
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index_of(key, shared.value)
            for batch in batches:
                docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = [(doc, *hit) for doc, text, x0, y0 in zip(docs, texts, _lists(batch.column("x0")), _lists(batch.column("y0")), strict=True) for hit in scan_page(text, x0, y0, index)]
                columns = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 2 else pa.int32()) for n, c in enumerate(columns)], ["doc_id", "item_id", "words", "first_line", "last_line"])

        one = pages.mapInArrow(run, "doc_id bigint, item_id bigint, words int, first_line int, last_line int")
        found = one if found is None else found.unionByName(one)
    return found


def _without(text: str, x0: list[int] | None, y0: list[int] | None, spans: list[tuple[int, int]]) -> str:
    """A page in printed order without the lines of spans, which count lines that have words."""
    lines = printed_lines(text, x0, y0)
    worded = [i for i, line in enumerate(lines) if WORD.search(fold(line))]
    dropped = {i for first, last in spans for i in worded[first : last + 1]}
    return "\n".join(line for i, line in enumerate(lines) if i not in dropped)


def remove_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, removed): all pages, those in `found` (of `leaks`) in printed order and without the leaking lines.

    A span goes from the line where a passage's words begin to the one where they end;
    adverts in between go with it. `removed` counts the items; pages with none keep
    their text as it is, NULL included.
    """
    spans = found.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("first_line", "last_line")).alias("_spans"), F.count_distinct("item_id").alias("removed"))
    pages = documents.select("doc_id", "text", F.col("lines.x0").alias("x0"), F.col("lines.y0").alias("y0")).join(spans, F.col("doc_id") == F.col("_d"), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, x0: pd.Series, y0: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        plain = lambda a: None if a is None else a.tolist()
        return pd.Series([t if f is None else _without(t, plain(x), plain(y), list(zip(f, e))) for t, x, y, f, e in zip(text, x0, y0, first, last, strict=True)], dtype=object)

    leaking = pages.where(F.col("_d").isNotNull()).withColumn("text", cut("text", "x0", "y0", "_spans.first_line", "_spans.last_line"))
    return pages.where(F.col("_d").isNull()).unionByName(leaking).select("doc_id", "text", F.coalesce("removed", F.lit(0)).alias("removed"))
