"""Fuzzy repeated passages by collinear chaining.

1. All word 5-grams are seeds. A seed's occurrences are joined with the document of least id that has it (first among
   documents held together, then among what tasks send on: all places in the first document): no pairs among the others.
   15-word windows chosen by winnowing are seeds too, joined with leaders of their own: of any 30 words that an earlier
   document has as well, a window is chosen in both, so they are found with a document that has them, wherever their
   5-grams occur besides.
2. Seeds side by side in both documents are one segment. Segments of two documents are chained in order of both: a
   Fenwick tree over positions in the one gives the best predecessor while the other is swept, less a cost for gaps.
3. Chains are aligned on the words themselves: gaps between segments are compared, and ends extended over words changed,
   lost and added. Chains whose aligned words agree by ``IDENTITY`` count.
   Chains within words that others, sure to count, cover already are left out before that.
4. A document's chains, whatever documents they match, unite to passages; those of ``LEAST_WORDS`` or more are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import among, bounded_batches, by_slices, documents, stored, text_bytes
from .shingles import ODD, WIDTH, by_range, mixed, ranged, word_hashes

GAP_COST = 0.06
LEAST_CHAIN, LEAST_WORDS = 15, 50
WINNOW = 16
REACH = 20
IDENTITY = 0.8
#: How many words on a chain is extended at most, how far an extension may fall below its best, and from the diagonal.
PAD, DROP, BAND = 100, 8, 16
LOW = -(10**6)
JOIN = 3  # words that may lie between chains of one passage
HELD_SEEDS = 1_000_000


def words_in(text: bytes) -> list[bytes]:
    return text.lower().split()


def sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``size`` values side by side."""
    width = 1
    while 2 * width <= size:
        values = best(values[:-width], values[width:])
        width *= 2
    return best(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the values that are the least of some WINNOW side by side, or of all where there are fewer."""
    if len(h) < WINNOW:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    least = sliding(h, WINNOW, np.minimum)
    edge = np.zeros(WINNOW - 1, h.dtype)
    return np.flatnonzero(sliding(np.r_[edge, least, edge], WINNOW, np.maximum) == h)


def seeds_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-grams and of the chosen windows, and where each begins: twice the place, plus 1 for a window."""
    n = len(words) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = word_hashes(words)
    total = own[:n] * ODD[0]
    for k in range(1, WIDTH):
        total += own[k : k + n] * ODD[k]
    # a word repeated on and on makes one 5-gram; counted along such a run they differ, and runs match from their beginnings
    new = np.flatnonzero(np.r_[True, total[1:] != total[:-1]])
    along = np.arange(n) - np.repeat(new, np.diff(np.r_[new, n]))
    total = mixed(total + along.astype(np.uint64) * ODD[1])
    m = max(0, n - LEAST_CHAIN + WIDTH)
    wide = mixed(sum((total[k : k + m] * ODD[k // WIDTH] for k in range(0, LEAST_CHAIN, WIDTH)), np.zeros(m, np.uint64)))
    at = winnowed(wide)
    first, paired = pairs_of(total)
    place = np.r_[2 * np.arange(n), 2 * first, 2 * at + 1]
    order = np.argsort(place, kind="stable")
    return np.r_[total, paired, wide[at]][order], place[order]


def pairs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a third of the 5-grams (by hash) the place, and a hash of it with the least of those that begin up to REACH words after it ends."""
    n = len(h) - WIDTH - REACH
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.uint64(2**16 - 1)
    least = sliding(h[WIDTH:] & ~low | np.arange(WIDTH, len(h), dtype=np.uint64) & low, REACH + 1, np.minimum)[:n]
    at = np.flatnonzero(h[:n] % np.uint64(3) == 0)
    other = at + ((least[at] & low).astype(np.int64) - at) % 2**16
    return at, mixed(h[at] * ODD[2] + h[other] * ODD[3])


def to_leaders(token: np.ndarray) -> np.ndarray:
    """For each entry, of entries in the order of doc and place, the first one with its token."""
    order = np.argsort(token, kind="stable")
    begins = np.flatnonzero(np.r_[len(order) > 0, token[order][1:] != token[order][:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
    return out


def short_steps(place: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes]:
    """Places that rise within a document, as steps of a byte and the steps that don't fit one."""
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    return np.minimum(step, 255).astype(np.uint8).tobytes(), step[step >= 255].astype("<u4").tobytes()


def long_places(steps: bytes, large: bytes, counts: np.ndarray) -> np.ndarray:
    step = np.frombuffer(steps, np.uint8).astype(np.int64)
    step[step == 255] = np.frombuffer(large, "<u4")
    first = np.cumsum(counts) - counts
    total = np.cumsum(step)
    return total - np.repeat(total[first] - step[first], counts)


ENTRY = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("steps", pa.binary()), ("large", pa.binary()), ("matches", pa.binary())])
ENTRY_TYPES = "bucket int, part int, docs binary, counts binary, tokens binary, steps binary, large binary, matches binary"


def packed_matches(doc: np.ndarray, place: np.ndarray, leader: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Entries whose leader is in another document: their places with the leader's, by range of documents, compressed."""
    item = np.flatnonzero(doc[leader] != doc)
    item = item[np.lexsort((place[item], doc[leader[item]], doc[item]))]
    coder, rows = zstandard.ZstdCompressor(level=1), []
    for part, some in by_range(ranged(mixed(doc[item].view(np.uint64)), buckets)):
        own, to = item[some], leader[item[some]]
        columns = [(doc[own], "<i8"), (doc[to], "<i8"), (place[own], "<i4"), (place[to] // 2, "<i4")]
        rows.append((part, coder.compress(b"".join(np.diff(c, prepend=0).astype(kind).tobytes() for c, kind in columns))))
    return rows


def unpacked_matches(rows: list[bytes]) -> list[np.ndarray]:
    """doc, leader, place, place in the leader."""
    coder, parts = zstandard.ZstdDecompressor(), []
    for r in map(coder.decompress, rows):
        n = len(r) // 24
        parts.append([np.cumsum(np.frombuffer(r, kind, n, at * n), dtype=np.int64) for kind, at in (("<i8", 0), ("<i8", 8), ("<i4", 16), ("<i4", 20))])
    return [np.concatenate(c) for c in zip(*parts)]


def seed_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """ENTRY. Rows with a bucket: of seeds in this hash range all places in the first of the documents held together. With a part: matches found among these, by range of documents."""

    def listed(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = sorted(held)
        token, place = (np.concatenate([held[i][k] for i in ids]) for k in (0, 1))
        doc = np.repeat(np.array(ids, np.int64), [len(held[i][0]) for i in ids])
        leader = to_leaders(token)
        rows = [(None, part, None, None, None, None, None, packed) for part, packed in packed_matches(doc, place, leader, buckets)]
        sent = np.flatnonzero(doc[leader] == doc)
        token, doc, place = mixed(token[sent]), doc[sent], place[sent]
        for bucket, own in by_range(ranged(token, buckets)):
            some, first, counts = np.unique(doc[own], return_index=True, return_counts=True)
            rows.append((bucket, None, np.diff(some, prepend=0).tobytes(), counts.astype("<u4").tobytes(), token[own].astype("<u4").tobytes(), *short_steps(place[own], first), None))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(ENTRY)], schema=ENTRY)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # rows that repeat a doc_id are the same document
                if i not in held and len((own := seeds_of(words_in(text.as_py())))[0]):
                    held[i] = own
                    size += len(own[0])
                if size > HELD_SEEDS:
                    yield listed(held)
                    held, size = {}, 0
        if held:
            yield listed(held)

    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return named.mapInArrow(find, ENTRY_TYPES)


def matches(lists: DataFrame, buckets: int) -> DataFrame:
    """part, matches: for a range of documents, places of seeds in a document and in the one of least id that has the seed."""
    schema = pa.schema([("part", pa.int32()), ("matches", pa.binary())])

    def settle(held: list) -> pa.RecordBatch:
        counts = [np.frombuffer(r[2], "<u4").astype(np.int64) for r in held]
        token = np.concatenate([np.frombuffer(r[3], "<u4") for r in held])
        order = np.argsort(token, kind="stable")
        again = token[order][1:] == token[order][:-1]
        own = order[np.r_[False, again] | np.r_[again, False]]
        doc = np.concatenate([np.repeat(np.cumsum(np.frombuffer(r[1], np.int64)), n) for r, n in zip(held, counts)])[own]
        place = np.concatenate([long_places(r[4], r[5], n) for r, n in zip(held, counts)])[own]
        order = np.lexsort((place, doc))
        rows = packed_matches(doc[order], place[order], to_leaders(token[own][order]), buckets)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            within = batch.filter(pa.compute.is_null(batch.column(0)))
            if within.num_rows:
                yield pa.RecordBatch.from_arrays([within.column(1), within.column(7)], schema=schema)
            own = batch.filter(pa.compute.is_valid(batch.column(0)))
            for row in zip(*(own.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                if held and held[0][0] != row[0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return lists.repartitionById(buckets, F.coalesce("bucket", "part")).sortWithinPartitions("bucket").mapInArrow(join, "part int, matches binary")


class Fenwick:
    """Greatest (value, item) among the first places."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = value, item
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while place:
            found = max(found, self.best[place])
            place -= place & -place
        return found


def segments(doc: np.ndarray, leader: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of number of the pair of documents, begin in the document, begin in the leader, last seed's distance; of pairs whose seeds span LEAST_CHAIN words. And the pairs: doc, leader."""
    wide, x = place % 2 == 1, place // 2
    steps = range(WIDTH, LEAST_CHAIN, WIDTH)
    doc, leader = (np.concatenate([c, *(c[wide] for _ in steps)]) for c in (doc, leader))
    x, y = (np.concatenate([c, *(c[wide] + k for k in steps)]) for c in (x, y))
    order = np.lexsort((x, y - x, leader, doc))
    doc, leader, x, y = doc[order], leader[order], x[order], y[order]
    pair = np.r_[True, (doc[1:] != doc[:-1]) | (leader[1:] != leader[:-1])]
    edges = np.flatnonzero(pair)
    far = np.maximum.reduceat(x, edges) - np.minimum.reduceat(x, edges) + WIDTH >= LEAST_CHAIN
    new = pair | np.r_[True, (np.diff(y - x) != 0) | (np.diff(x) > WIDTH)]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:] - 1, len(x) - 1]
    number = (np.cumsum(pair) - 1)[begin]
    kept = far[number]
    return np.stack([number, x[begin], y[begin], x[last] - x[begin]], 1)[kept], np.stack([doc[edges], leader[edges]], 1)


def chains(found: list[tuple[int, int, int]]) -> list[list[int]]:
    """Chains of segments (item numbers), best first; no segment is in two.

    A segment is begin, begin in the other text, distance of its last seed. A chain's score: WIDTH for each segment and
    a word for each step along it, less GAP_COST for each word of either text between starts of seeds.
    """
    if len(found) == 1:
        return [[0]]
    ranks = {v: k for k, v in enumerate(sorted({b + n for _, b, n in found}))}
    ends = sorted(ranks)
    tree = Fenwick(len(ends))
    score, back = [0.0] * len(found), [-1] * len(found)
    turns = sorted([(a, 0, i) for i, (a, _, _) in enumerate(found)] + [(a + n, 1, i) for i, (a, _, n) in enumerate(found)])
    for _, ended, i in turns:
        a, b, n = found[i]
        if ended:
            tree.put(ranks[b + n], score[i] + GAP_COST * (a + b + 2 * n), i)
            continue
        own = WIDTH + (1 - 2 * GAP_COST) * n
        low = np.searchsorted(ends, b)
        value, j = tree.before(int(low))
        if j >= 0 and value > GAP_COST * (a + b):
            back[i] = j
            own += value - GAP_COST * (a + b)
        score[i] = own
    used, out = [False] * len(found), []
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def covering(found: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """A document's chains (leader, segments) less those that can't add to its passages.

    Chains whose seeds alone agree by IDENTITY hold whatever alignment finds. Few of them that cover all words which
    they cover together are enough, and other chains within these words add nothing. So a text that has a
    thousand near copies before it has chains in proportion to its length, not to their number.
    """
    begin = np.array([s[0, 0] for _, s in found])
    end = np.array([s[-1, 0] + s[-1, 2] + WIDTH for _, s in found])
    agreed = np.array([s[:, 2].sum() + WIDTH * len(s) - np.maximum(0, WIDTH - np.minimum(np.diff(s[:, 0]) - s[:-1, 2], np.diff(s[:, 1]) - s[:-1, 2])).sum() for _, s in found])
    longest = np.maximum(end - begin, [s[-1, 1] + s[-1, 2] + WIDTH - s[0, 1] for _, s in found])
    sure = np.flatnonzero(agreed >= IDENTITY * longest)
    sure = sure[np.lexsort((-end[sure], begin[sure]))]
    kept, spans, at, k = [], [], -1, 0
    while k < len(sure):
        if begin[sure[k]] > at:
            # a new stretch begins with the longest chain that begins there
            spans.append([begin[sure[k]], end[sure[k]]])
            kept.append(sure[k])
            at = end[sure[k]]
        best = -1
        while k < len(sure) and begin[sure[k]] <= at:
            if best < 0 or end[sure[k]] > end[best]:
                best = sure[k]
            k += 1
        if best >= 0 and end[best] > at:
            kept.append(best)
            spans[-1][1] = at = end[best]
    edges = np.array(spans, np.int64).reshape(-1, 2)
    rest = np.setdiff1d(np.arange(len(found)), sure)
    within = np.searchsorted(edges[:, 0], begin[rest], side="right") - 1
    out = rest[(within < 0) | (end[rest] > (np.r_[edges[:, 1], 0])[within])]
    return [found[i] for i in sorted([*kept, *out.tolist()])]


CHAIN = "doc long, leader long, segments binary, first long, last long"


def chained(found: DataFrame, buckets: int) -> DataFrame:
    """CHAIN: each chain's segments and the stretch of the leader's words to align with."""
    schema = pa.schema([("doc", pa.int64()), ("leader", pa.int64()), ("segments", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [m for batch in batches for m in batch.column(1).to_pylist()]
        if not held:
            return
        own, pairs = segments(*unpacked_matches(held))
        edges = np.flatnonzero(np.r_[True, np.diff(own[:, 0]) > 0, True]) if len(own) else np.zeros(1, int)
        by_doc: dict[int, list[tuple[int, np.ndarray]]] = {}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            some = own[a:b, 1:]
            doc, leader = pairs[own[a, 0]].tolist()
            for chain in chains(list(map(tuple, some.tolist()))):
                s = some[chain]
                if s[-1, 0] + s[-1, 2] - s[0, 0] + WIDTH >= LEAST_CHAIN:
                    by_doc.setdefault(doc, []).append((leader, s))
        rows = []
        for doc, found in by_doc.items():
            for leader, s in covering(found):
                rows.append((doc, leader, s.astype("<u4").tobytes(), max(0, int(s[0, 1]) - PAD), int(s[-1, 1] + s[-1, 2]) + WIDTH + PAD))
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 10_000]], f.type) for c, f in enumerate(schema)], schema=schema)

    return found.repartitionById(buckets, F.col("part")).mapInArrow(link, CHAIN)


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, packed: the lower-cased text, compressed, of documents in ``ids`` (and a few others)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.compress(t.as_py().lower()) for t in batch.column(1)], pa.binary())], names=["doc", "packed"])

    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return among(named, ids).select("doc", text_bytes().alias("text")).mapInArrow(pack, "doc long, packed binary")


def with_stretches(chain: DataFrame, packed: DataFrame) -> DataFrame:
    """doc and its chains, each with the hashes of the leader's words in the stretch."""
    schema = pa.schema([("doc", pa.int64()), ("leader", pa.int64()), ("segments", pa.binary()), ("first", pa.int64()), ("stretch", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, own = zstandard.ZstdDecompressor(), None, np.zeros(0, np.uint64)
        for batch in batches:
            stretches = []
            for leader, first, last, packed in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5))):
                if leader != at:
                    at, own = leader, word_hashes(coder.decompress(packed).split())
                stretches.append((own[first:last] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(stretches, pa.binary())], schema=schema)

    joined = chain.join(packed.select(F.col("doc").alias("leader"), "packed"), "leader").select("doc", "leader", "segments", "first", "last", "packed")
    cuts = joined.mapInArrow(cut, "doc long, leader long, segments binary, first long, stretch binary")
    return cuts.groupBy("doc").agg(F.collect_list(F.struct("leader", "segments", "first", "stretch")).alias("chains"))


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a longest common subsequence; equal ends are taken first."""
    n = min(len(a), len(b))
    head = int((np.r_[a[:n] != b[:n], True]).argmax())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = int((np.r_[a[::-1][:n] != b[::-1][:n], True]).argmax())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    return head + tail + int(row[-1])


def extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two sequences go on alike from their beginnings, in either, and how many words agree there.

    The best alignment of beginnings: a word for each that agrees, less one for each that is changed, lost or added. It
    goes on until it has fallen DROP below its best, or is BAND words off the diagonal.
    """
    n, m = min(len(a), PAD), min(len(b), PAD)
    # words that agree one by one are taken at once
    head = int((np.r_[a[: min(n, m)] != b[: min(n, m)], True]).argmax())
    a, b, n, m = a[head:n], b[head:m], n - head, m - head
    far = (0, 0)
    if n and m:
        top, j = 0, np.arange(m + 1)
        row = np.where(j <= BAND, -j, LOW)
        for i in range(1, n + 1):
            step = row - 1
            step[1:] = np.maximum(step[1:], row[:-1] + np.where(b == a[i - 1], 1, -1))
            step[np.abs(j - i) > BAND] = LOW
            row = np.maximum.accumulate(step + j) - j
            best = int(row.argmax())
            if row[best] > top:
                top, far = row[best], (i, best)
            elif row[best] < top - DROP:
                break
    return head + far[0], head + far[1], head + common_words(a[: far[0]], b[: far[1]])


def aligned(words: np.ndarray, found: np.ndarray, stretch: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Begin and end in the document, begin in the stretch, and the share of aligned words that agree. Segments count in the stretch.

    A chain is cut at gaps that cost more than DROP, by the measure of ``extended``: what lies on either side may be alike
    where the whole isn't.
    """
    parts: list[list] = []
    for x, y, n in found.tolist():
        equal = n + WIDTH
        if parts:
            *_, a, b, before = parts[-1]
            over = max(0, a - x, b - y)
            common = -over if over else common_words(words[a:x], stretch[b:y])
            if over or 2 * common - max(x - a, y - b) >= -DROP:
                parts[-1][2:] = x + n + WIDTH, y + n + WIDTH, before + common + equal
                continue
        parts.append([x, y, x + n + WIDTH, y + n + WIDTH, equal])
    for x0, y0, a, b, equal in parts:
        before, before_y, left = extended(words[:x0][::-1], stretch[:y0][::-1])
        after, after_y, right = extended(words[a:], stretch[b:])
        begin, end = x0 - before, a + after
        longest = max(end - begin, b - y0 + before_y + after_y)
        yield begin, end, y0 - before_y, min(1.0, (equal + left + right) / longest)


PASSAGE = "doc_id long, start_word long, end_word long, n_words long, identity double, source_id long, source_start long, n_chains long"


def united(spans: list[tuple[int, int, float, int, int]]) -> Iterator[tuple]:
    """Passages of begin, end, n, identity and source of the longest chain, number of chains."""
    group: list[tuple] = []
    end = 0
    for s in [*sorted(spans), None]:
        if group and (s is None or s[0] > end + JOIN):
            begin = group[0][0]
            if end - begin >= LEAST_WORDS:
                top = max(group, key=lambda g: (g[1] - g[0], -g[3]))
                yield begin, end, end - begin, top[2], top[3], top[4], len(group)
            group = []
        if s is not None:
            end = max(end, s[1]) if group else s[1]
            group.append(s)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """PASSAGE: a row per passage (in words of the lower-cased text) that a document of smaller id has too, exactly or nearly.

    Documents without any have no row; null, empty and short texts have none. Rows with a null doc_id take no part; rows
    that repeat a doc_id are the same document. Where several earlier documents have a passage, source_id is one of them.
    """
    buckets = int(bounded_batches(docs).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chain = stored(chained(matches(seed_lists(docs, buckets), buckets), buckets), "chains")
    packed = packed_texts(docs, stored(chain.select(F.explode(F.array("doc", "leader")).alias("doc")).distinct(), "chained-documents"))
    joined = packed.join(with_stretches(chain, packed), "doc").select("doc", "packed", "chains")
    schema = pa.schema([(f.split()[0], pa.float64() if f.endswith("double") else pa.int64()) for f in PASSAGE.split(", ")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed_text, found in zip(*(c.to_pylist() for c in batch.columns)):
                words = (word_hashes(coder.decompress(packed_text).split()) >> np.uint64(32)).astype(np.uint32)
                spans = []
                for c in found:
                    own = np.frombuffer(c["segments"], "<u4").astype(np.int64).reshape(-1, 3) - [0, c["first"], 0]
                    for begin, end, at, identity in aligned(words, own, np.frombuffer(c["stretch"], "<u4")):
                        if identity >= IDENTITY and end - begin >= LEAST_CHAIN:
                            spans.append((begin, end, identity, c["leader"], at + c["first"]))
                rows += [(doc, *p) for p in united(spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return joined.mapInArrow(align, PASSAGE).dropDuplicates(["doc_id", "start_word"])


def op3_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
