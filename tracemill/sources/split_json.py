"""One JSON trace document read by many tasks.

Spark's text reader cuts a file into byte ranges and gives each task its pieces between closing braces; a brace within a
string cuts too, which does no harm, as pieces are put together again. What a range means depends on what stands before
it: whether it begins within a string, and how deep. So there are three passes, the first two of which return a row a range:

1. Every range says how it changes the state of whoever comes in: whether its quotes are odd in number, and by how much the
   depth changes for one who comes in outside a string, and for one who comes in within.
2. These changes, put together in the order of the ranges, give the true state at each range's start. With it a range finds
   the arrays of events that it opens, counts the elements, and lays aside those parts of elements that its ends cut.
3. Put together again, the counts give every element its place. Tasks emit the elements that lie within their range;
   those that were cut are joined from their parts.

A range never begins within an escape, and a key never stands apart from the bracket of its array: no brace can be between.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored

EVENTS_KEY = "traceEvents"
CHUNK = 4 * 2**20
#: A range's state is some numbers on the driver and in every task; so many ranges of 128 MB are 128 TB.
RANGES = 1_000_000
QUOTE, COMMA, OPEN, CLOSE = 34, 44, 91, 93
_WANTED = np.zeros(256, bool)
_WANTED[list(b'"{}[],')] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


@dataclass(frozen=True)
class State:
    """Where one stands: within a string, how deep, in an array of events, the how manieth array that is, and how many of its elements are over."""

    inside: bool = False
    depth: int = 0
    among: bool = False
    number: int = 0
    place: int = 0


def signs(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, brackets and commas, what they are, and whether they stand within a string (a quote that opens one doesn't). Escaped quotes are left out."""
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_WANTED[b])
    # a quote after an odd number of backslashes belongs to the text
    doubtful = np.flatnonzero((b[at] == QUOTE) & (at > 0) & (b[at - 1] == 92))
    if len(doubtful):
        escaped, still, back = np.zeros(len(doubtful), bool), np.ones(len(doubtful), bool), 1
        while still.any():
            escaped ^= still
            back += 1
            before = at[doubtful] - back
            still &= (before >= 0) & (b[before] == 92)
        at = np.delete(at, doubtful[escaped])
    kind = b[at]
    quotes = (kind == QUOTE).cumsum() - (kind == QUOTE)
    return at, kind, (quotes + inside) % 2 == 1


def change(text: bytes) -> tuple[int, int, int]:
    """A text's odd quotes (0 or 1), and by how much it changes the depth of one who comes in outside and within a string."""
    _, kind, within = signs(text, False)
    step = _STEP[kind]
    return int((kind == QUOTE).sum() % 2), int(step[~within].sum()), int(step[within].sum())


def walked(text: bytes, state: State) -> tuple[State, list[int], list[tuple[int, int, int, int]]]:
    """The state after a text; the places of its boundaries of elements; and its whole elements: array, place, begin, end."""
    at, kind, within = signs(text, state.inside)
    step = np.where(within, 0, _STEP[kind])
    depth = state.depth + step.cumsum()
    opens = np.flatnonzero((kind == OPEN) & ~within & (depth == 2))
    # an opening bracket after a string is the value of that key
    opens = [i for i in opens.tolist() if i >= 2 and kind[i - 1] == kind[i - 2] == QUOTE and _is_key(text[at[i - 2] : at[i - 1] + 1])]
    closes = np.flatnonzero((kind == CLOSE) & ~within & (depth == 1))
    turns = np.sort(np.r_[opens, closes].astype(np.int64))
    opening = np.isin(turns, opens)
    commas = np.flatnonzero((kind == COMMA) & ~within & (depth == 2))
    last = np.searchsorted(turns, commas) - 1
    commas = commas[np.where(last >= 0, opening[last] if len(turns) else False, state.among)]
    among_before = np.r_[state.among, opening][:-1] if len(turns) else np.zeros(0, bool)
    bounds = np.sort(np.r_[commas, turns[opening | among_before]].astype(np.int64))
    now, begin, elements, places = state, None, [], at[bounds].tolist()
    for i, place in zip(bounds.tolist(), places):
        if now.among and begin is not None:
            elements.append((now.number, now.place, begin, place))
        if kind[i] == OPEN:
            now = replace(now, among=True, number=now.number + 1, place=0)
        elif kind[i] == COMMA:
            now = replace(now, place=now.place + 1)
        else:
            now = replace(now, among=False)
        begin = place + 1
    odd = bool((kind == QUOTE).sum() % 2)
    return replace(now, inside=state.inside ^ odd, depth=int(depth[-1]) if len(depth) else state.depth), places, elements


def _is_key(token: bytes) -> bool:
    try:
        return json.loads(token) == EVENTS_KEY
    except ValueError:
        return False


def chunks(pieces: Iterator[bytes], size: int = CHUNK) -> Iterator[bytes]:
    """Pieces with their braces, put together to some megabytes."""
    held, total = [], 0
    for piece in pieces:
        held += [piece, b"}"]
        total += len(piece) + 1
        if total >= size:
            yield b"".join(held)
            held, total = [], 0
    if held:
        yield b"".join(held)


def elements(texts: Iterator[bytes], state: State) -> Iterator[tuple[int, int, bytes, bool] | State]:
    """Array, place, text, whole of the elements of texts that follow each other; not whole are what the beginning and the end of it all cut. At last the state."""
    held: list[bytes] = []
    cut = True
    for text in texts:
        before, (state, places, whole) = state, walked(text, state)
        if not places:
            held += [text] if before.among else []
            continue
        if before.among:
            yield before.number, before.place, b"".join([*held, text[: places[0]]]), not cut
        yield from ((n, i, text[a:b], True) for n, i, a, b in whole)
        held, cut = [text[places[-1] + 1 :]] if state.among else [], False
    if state.among:
        yield state.number, state.place, b"".join(held), False
    yield state


def pieces_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, begin (of the byte range), piece, in the order of the file within a range."""
    return spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("piece"))


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[bytes]]]:
    """Each range of a task with its pieces."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, own in groupby(rows, key=lambda r: r[:3]):
        yield key, (r[3] for r in own)


def states(pieces: DataFrame) -> tuple[dict[tuple[str, int], State], dict[str, int], DataFrame]:
    """The state at the start of each range, the number of each file's last array of events, and path, begin and the parts of elements cut by the range's ends.

    Raises ValueError for a file that isn't a whole object with such an array.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, size, begin), own in ranges(batches):
            odd, outside, within, n, first = 0, 0, 0, 0, b""
            for text in chunks(own):
                o, a, b = change(text)
                outside, within = (outside + b, within + a) if odd else (outside + a, within + b)
                odd, n, first = odd ^ o, n + len(text), first or text.lstrip()[:1]
            yield pa.RecordBatch.from_pylist([{"path": path, "size": size, "begin": begin, "odd": odd, "outside": outside, "within": within, "n": n, "first": first}], schema=_CHANGES)

    found = pieces.mapInArrow(measure, "path string, size long, begin long, odd int, outside long, within long, n long, first binary").limit(RANGES + 1).collect()
    if len(found) > RANGES:
        raise ValueError(f"more than {RANGES} byte ranges: raise spark.sql.files.maxPartitionBytes")
    start: dict[tuple[str, int], State] = {}
    ends: dict[str, tuple[State, int, int]] = {}
    for r in sorted(found, key=lambda r: (r["path"], r["begin"])):
        now, n, _ = ends.get(r["path"], (State(), 0, 0))
        if not n and r["first"] != b"{":
            raise ValueError(r["path"])
        start[r["path"], r["begin"]] = now
        ends[r["path"]] = State(now.inside ^ bool(r["odd"]), now.depth + (r["within"] if now.inside else r["outside"])), n + r["n"], r["size"]
    for path, (now, n, size) in ends.items():
        # the last piece may end with the file, not with a brace; a packed file doesn't tell which
        right = {0 if n == size else -1} if n in (size, size + 1) else {0, -1}
        if now.inside or now.depth not in right:
            raise ValueError(path)
    shipped = pieces.sparkSession.sparkContext.broadcast(start)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, _, begin), own in ranges(batches):
            # taken to begin among events: the driver knows whether that is so
            head = tail = state = None
            for item in elements(chunks(own), replace(shipped.value[path, begin], among=True)):
                if isinstance(item, State):
                    state = item
                elif not item[3]:
                    head, tail = (item[2], tail) if head is None and item[:2] == (0, 0) else (head, item[2])
            yield pa.RecordBatch.from_pylist([{"path": path, "begin": begin, "head": head, "tail": tail, "among": state.among, "number": state.number, "place": state.place}], schema=_CUTS)

    cuts = stored(pieces.mapInArrow(cut, "path string, begin long, head binary, tail binary, among boolean, number int, place long"), "cuts")
    last: dict[str, State] = {}
    for r in cuts.drop("head", "tail").orderBy("path", "begin").collect():
        now = last.get(r["path"], State())
        start[r["path"], r["begin"]] = replace(start[r["path"], r["begin"]], among=now.among, number=now.number, place=now.place)
        if r["number"]:
            now = State(among=r["among"], number=now.number + r["number"], place=r["place"])
        elif now.among:
            now = State(among=r["among"], number=now.number, place=now.place + r["place"])
        last[r["path"]] = now
    arrays = {path: now.number for path, now in last.items()}
    if missing := [path for path, n in arrays.items() if not n]:
        raise ValueError(missing[0])
    return start, arrays, cuts


_CHANGES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("begin", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("within", pa.int64()), ("n", pa.int64()), ("first", pa.binary())])
_CUTS = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("among", pa.bool_()), ("number", pa.int32()), ("place", pa.int64())])
_ELEMENTS = pa.schema([("path", pa.string()), ("ord", pa.int64()), ("value", pa.string())])


def split_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, ord, value: the elements of each document's array of events (the last, if it has several) as JSON text.

    A plain file is read by as many tasks as it has byte ranges (spark.sql.files.maxPartitionBytes), a packed one by one
    task; neither is held in memory whole. The first two passes run at once.
    """
    pieces = pieces_of(spark, paths)
    start, arrays, cuts = states(pieces)
    shipped = spark.sparkContext.broadcast((start, arrays))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = shipped.value
        for (path, _, begin), own in ranges(batches):
            held, size = [], 0
            for item in elements(chunks(own), at[path, begin]):
                if not isinstance(item, State) and item[3] and item[0] == last[path]:
                    held.append((path, item[1], item[2]))
                    size += len(item[2])
                if held and (size >= CHUNK or isinstance(item, State)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held]), pa.array([r[1] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.binary()).cast(pa.string())], schema=_ELEMENTS)
                    held, size = [], 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = shipped.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now, key = at[r["path"], r["begin"]], r["path"]
                if now.among and now.number == last[key] and r["head"] is not None:
                    out.append((key, now.place, r["begin"], r["head"]))
                number = now.number + r["number"]
                if r["tail"] is not None and number == last[key] and (now.among or r["number"]):
                    out.append((key, r["place"] if r["number"] else now.place + r["place"], r["begin"], r["tail"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())], names=["path", "ord", "begin", "part"])

    whole = pieces.mapInArrow(emit, "path string, ord long, value string")
    split = cuts.mapInArrow(parts, "path string, ord long, begin long, part binary").groupBy("path", "ord").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("p"))
    joined = split.select("path", "ord", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"])).cast("string").alias("value"))
    every = whole.unionByName(joined)
    # an empty array has one empty element
    return every.filter((F.col("ord") > 0) | (F.regexp_replace("value", r"\s", "") != ""))
