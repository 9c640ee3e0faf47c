"""Removing byte strings that a document with a smaller id has too, by suffix arrays of what can repeat.

1. Every ``length``-byte window has a minimizer, its 20-byte string of least hash. Equal windows have equal ones, so
   windows whose minimizer no other document has are done with. Minimizers of a batch that meet within it are settled
   there; one of each goes to the task of its hash range, which finds those that several documents have.
2. What is left of a document, its windows that may repeat, is cut into runs of windows that share a minimizer; a run
   is a short string. Equal windows are in runs of the same minimizer, whatever their documents.
3. Of a batch's equal strings only those of its least document go on; the rest are settled. A task has all strings of
   a range of minimizers. Equal strings are one entry with the least doc_id of theirs. Minimizers with several strings
   get a suffix array: neighbours that share ``length`` bytes have the least doc_id among them for the window.
4. Windows whose least doc_id is smaller than their own document's are removed, judged on the input.
Texts are shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, by_slices, documents, stored, text_bytes
from .shingles import ODD, by_range, mixed, ranged
from .suffix_array import common_prefixes, suffix_array

LENGTH = 50
SEED = 20
SEED_BYTES, ARRAY_BYTES = 16_000_000, 500_000


def least_hashes(text: bytes, gram: int, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the least hash of its ``gram``-byte strings (gram from 8 to 24)."""
    n, span = len(text) - gram + 1, length - gram + 1
    if n < span:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, at in enumerate(sorted({0, min(8, gram - 8), gram - 8})):
        h = (h ^ np.ndarray((n,), np.dtype("<u8"), buffer=text, offset=at, strides=(1,))) * ODD[k]
        h ^= h >> np.uint64(31)
    h = mixed(h)
    size = 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (span - size)], h[span - size :]) if span > size else h


def unique_id(doc_id: int | None, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=(doc_id or 0) & (2**64 - 1)) - 2**63


def seeds(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """bucket, uids, counts, hashes: minimizers of some texts by hash range, by document. Negative buckets: uids whose minimizers (whole hashes) are known to repeat."""
    schema = pa.schema([("bucket", pa.int32()), ("uids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, b - a) for batch in batches for a, b in by_slices(batch, 1, SEED_BYTES)):
            uids, found = [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                text = text.as_py()
                # least hashes crowd near zero; mixed again they spread over the buckets
                own = mixed(np.unique(least_hashes(text, SEED, length))) if len(text) >= length else []
                if len(own):
                    uids.append(unique_id(i, text))
                    found.append(own)
            if not uids:
                continue
            h, doc = np.concatenate(found), np.repeat(np.arange(len(uids)), [len(x) for x in found])
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            head = np.r_[True, h[1:] != h[:-1]]
            several = ~(head & np.r_[h[1:] != h[:-1], True])
            uid = np.array(uids, np.int64)
            rows = [] if not several.any() else [(-1, *by_document(uid, doc[several], h[several]))]
            h, doc = h[head], doc[head]
            for k, own in by_range(ranged(h, buckets)):
                rows.append((k, *by_document(uid, doc[own], (h[own] & np.uint64(2**32 - 1)).astype("<u4"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(find, "bucket int, uids binary, counts binary, hashes binary")


def by_document(uid: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[bytes, bytes, bytes]:
    order = np.argsort(doc, kind="stable")
    own, counts = np.unique(doc, return_counts=True)
    return uid[own].tobytes(), counts.astype("<u4").tobytes(), h[order].tobytes()


def repeated_seeds(found: DataFrame, buckets: int) -> DataFrame:
    """uid, keys: a document's minimizers that another one has, as numbers of bucket and low hash half; a row a document.

    What a task finds travels by groups of documents, a row a group.
    """
    schema = pa.schema([("part", pa.int32()), ("uids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
    result = pa.schema([("uid", pa.int64()), ("keys", pa.binary())])

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        bucket = held[0][0]
        uid = np.concatenate([np.repeat(np.frombuffer(u, np.int64), np.frombuffer(c, "<u4")) for _, u, c, _ in held])
        if bucket < 0:
            h = np.concatenate([np.frombuffer(x, np.uint64) for *_, x in held])
            keys = ranged(h, buckets).astype(np.uint64) << np.uint64(32) | h & np.uint64(2**32 - 1)
        else:
            h = np.concatenate([np.frombuffer(x, "<u4") for *_, x in held])
            order = np.lexsort((uid, h))
            h, uid = h[order], uid[order]
            head = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(head) - 1
            last = np.r_[np.flatnonzero(head)[1:] - 1, len(h) - 1]
            again = (uid[head] != uid[last])[group]
            uid, keys = uid[again], np.uint64(bucket) << np.uint64(32) | h[again].astype(np.uint64)
        rows = []
        for part, own in by_range(ranged(mixed(uid.view(np.uint64)), buckets)):
            rows.append((part, *by_document(*np.unique(uid[own], return_inverse=True), keys[own])))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    def gathered(held: list) -> Iterator[pa.RecordBatch]:
        uid = np.concatenate([np.repeat(np.frombuffer(u, np.int64), np.frombuffer(c, "<u4")) for _, u, c, _ in held])
        order = np.argsort(uid, kind="stable")
        uid, keys = uid[order], np.concatenate([np.frombuffer(k, np.uint64) for *_, k in held])[order]
        edges = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1], True])
        for k in range(0, len(edges) - 1, 10_000):
            some = edges[k : k + 10_001]
            yield pa.RecordBatch.from_arrays([pa.array(uid[some[:-1]]), pa.array([keys[a:b].tobytes() for a, b in zip(some[:-1], some[1:])], pa.binary())], schema=result)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield from gathered(held)
                    held = []
                held.append(row)
        if held:
            yield from gathered(held)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # rows of what is settled already stand alone
                if held and (held[0][0] != row[0] or row[0] < 0):
                    yield from settle(held)
                    held = []
                held.append(row)
        if held:
            yield from settle(held)

    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("uids"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    matched = found.repartitionById(buckets, place).sortWithinPartitions("bucket").mapInArrow(match, "part int, uids binary, counts binary, keys binary")
    return matched.repartitionById(buckets, F.col("part")).sortWithinPartitions("part").mapInArrow(gather, "uid long, keys binary")


def packed_texts(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(map(unique_id, ids, texts), pa.int64()), batch.column(0), pa.array([coder.compress(t) for t in texts], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(pack, "uid long, doc_id long, packed binary")


RUN = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("starts", pa.binary()), ("stops", pa.binary()), ("texts", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("tags", pa.binary())])


def spans_by_document(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order].astype("<u4"), stop[order].astype("<u4")
    edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), True]) if len(doc) else np.zeros(1, int)
    return [(int(doc[a]), int(tag[a]), start[a:b].tobytes(), stop[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def window_runs(joined: DataFrame, buckets: int, length: int) -> DataFrame:
    """Strings of windows that may repeat, as RUN. Rows without a bucket: spans that a smaller document of the batch has as well, by document. Others: strings of a hash range, those with the batch's least doc_id only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            number: dict[bytes, int] = {}
            which: list[int] = []
            parts: list[tuple[np.ndarray, ...]] = []
            for uid, doc_id, packed, keys in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack.decompress(packed)
                whole = least_hashes(text, SEED, length)
                if not len(whole):
                    continue
                change = np.r_[True, whole[1:] != whole[:-1]]
                heads = mixed(whole[change])
                known = np.frombuffer(keys, np.uint64)
                may = np.isin(ranged(heads, buckets).astype(np.uint64) << np.uint64(32) | heads & np.uint64(2**32 - 1), known)
                edges = np.r_[np.flatnonzero(change), len(whole)]
                begin, end = edges[:-1][may], edges[1:][may] + (length - 1)
                which += [number.setdefault(text[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist())]
                parts.append((np.full(len(begin), doc_id, np.int64), np.full(len(begin), uid & (2**32 - 1), np.int64), begin, end, ranged(heads[may], buckets)))
            if not which:
                continue
            doc, tag, begin, end, bucket = map(np.concatenate, zip(*parts))
            string, texts = np.array(which), list(number)
            least = np.full(len(texts), 2**63 - 1)
            np.minimum.at(least, string, doc)
            settled = doc > least[string]
            rows = [(None, d, t, a, b, None, None, None, None) for d, t, a, b in spans_by_document(doc[settled], tag[settled], begin[settled], end[settled])]
            left = np.flatnonzero(~settled)
            left = left[np.argsort(doc[left], kind="stable")]
            for k, some in by_range(bucket[left]):
                own = left[some]
                joint = b"".join([texts[i] for i in string[own].tolist()])
                deltas = np.diff(doc[own], prepend=0)
                rows.append((k, None, None, begin[own].astype("<u4").tobytes(), None, pack.compress(joint), (end - begin)[own].astype("<u4").tobytes(), deltas.tobytes(), tag[own].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(RUN)], schema=RUN)

    return joined.select("uid", "doc_id", "packed", "keys").mapInArrow(cut, "bucket int, doc_id long, tag long, starts binary, stops binary, texts binary, sizes binary, docs binary, tags binary")


def least_documents(texts: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of each text the least of ``least`` among the texts that have it."""
    whole = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = suffix_array(whole)
    order = order[order + length <= ends[owner[order]]]  # a window ends within its text
    group = np.cumsum(common_prefixes(whole, order, length) < length) - 1
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    best = np.zeros(len(whole), np.int64)
    best[order] = np.minimum.reduceat(least[owner[order]], heads)[group] if len(order) else 0
    return [best[e - s : e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist())]


def routes_of(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The minimizer that the windows of each string share; hashes are made for ARRAY_BYTES at a time."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(texts), np.uint64)
    begin = 0
    while begin < len(texts):
        before = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + ARRAY_BYTES, side="right")))
        h = least_hashes(b"".join(texts[begin:end]), SEED, SEED)
        edges = np.stack([ends[begin:end] - sizes[begin:end], ends[begin:end] - SEED + 1], 1).ravel() - before
        out[begin:end] = np.minimum.reduceat(np.r_[h, np.uint64(0)], edges)[::2]
        begin = end
    return out


def repeated_windows(found: DataFrame, buckets: int, length: int) -> DataFrame:
    """doc_id, tag, starts, stops: spans of bytes of windows that a smaller document has, a row a document.

    A task answers for all documents; answers travel by groups of documents, a row a group.
    """
    answer = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("docs", "tags", "starts", "stops"))])
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("starts", pa.binary()), ("stops", pa.binary())])

    def settle(held: list) -> list[tuple[np.ndarray, ...]]:
        unpack = zstandard.ZstdDecompressor()
        number: dict[bytes, int] = {}
        string: list[int] = []
        for r in held:
            joint, at = unpack.decompress(r[5]), 0
            for n in np.frombuffer(r[6], "<u4").tolist():
                string.append(number.setdefault(joint[at : at + n], len(number)))
                at += n
        which, texts = np.array(string), list(number)
        start, tag = (np.concatenate([np.frombuffer(r[c], "<u4") for r in held]).astype(np.int64) for c in (3, 8))
        doc = np.concatenate([np.cumsum(np.frombuffer(r[7], np.int64)) for r in held])
        least = np.full(len(texts), 2**63 - 1)
        np.minimum.at(least, which, doc)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        route = routes_of(texts, sizes)
        order = np.argsort(route, kind="stable")
        edges = np.flatnonzero(np.r_[True, route[order][1:] != route[order][:-1], True])
        several = np.zeros(len(texts), bool)
        several[order] = np.repeat(np.diff(edges) > 1, np.diff(edges))
        # the only string of its minimizer: all its windows are the least document's
        whole = ~several[which] & (least[which] < doc)
        out = [(doc[whole], tag[whole], start[whole], start[whole] + sizes[which[whole]])]
        best: dict[int, np.ndarray] = {}
        some: list[int] = []
        size = 0
        for k in [*order[several[order]].tolist(), -1]:
            # a suffix array may hold strings of many minimizers, but all of each one's
            if some and (k < 0 or size > ARRAY_BYTES and route[k] != route[some[-1]]):
                best.update(zip(some, least_documents([texts[i] for i in some], least[some], length)))
                some, size = [], 0
            if k >= 0:
                some.append(k)
                size += len(texts[k])
        for i in np.flatnonzero(several[which]).tolist():
            gone = best[string[i]] < doc[i]
            if gone.any():
                turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                n = len(turns) // 2
                out.append((np.full(n, doc[i]), np.full(n, tag[i]), start[i] + turns[::2], start[i] + turns[1::2] - 1 + length))
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] is None:
                    starts, stops = np.frombuffer(row[3], "<u4"), np.frombuffer(row[4], "<u4")
                    out.append((np.full(len(starts), row[1]), np.full(len(starts), row[2]), starts, stops))
                    continue
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                held.append(row)
        if held:
            out += settle(held)
        doc, tag, start, stop = map(np.concatenate, zip(*out))
        own = list(by_range(ranged(mixed(doc.astype(np.int64).view(np.uint64)), buckets)))
        columns = [[k for k, _ in own]] + [[x[i].astype(kind).tobytes() for _, i in own] for x, kind in ((doc, "<i8"), (tag, "<u4"), (start, "<u4"), (stop, "<u4"))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, answer)], schema=answer)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        if held:
            doc, tag, start, stop = (np.concatenate([np.frombuffer(x[k], kind) for x in held]).astype(np.int64) for k, kind in enumerate(("<i8", "<u4", "<u4", "<u4")))
            rows = spans_by_document(doc, tag, start, stop)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    place = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    solved = found.repartitionById(buckets, place).sortWithinPartitions("bucket").mapInArrow(solve, "part int, docs binary, tags binary, starts binary, stops binary")
    return solved.repartitionById(buckets, F.col("part")).mapInArrow(gather, "doc_id long, tag long, starts binary, stops binary")


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


REMOVAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def repeated_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per row of ``docs``, REMOVAL: what is left when all bytes of repeated windows go. spans are the removed runs in bytes.

    A null text is empty. A row with a null doc_id neither loses bytes nor makes others lose any. Rows that repeat a
    doc_id are one document. An empty table gives none.
    """
    buckets = int(bounded_batches(docs).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    keys = stored(repeated_seeds(seeds(named, buckets, length), buckets), "seeds")
    packed = packed_texts(docs)
    found = window_runs(packed.filter("doc_id IS NOT NULL").join(keys, "uid"), buckets, length)
    gone = repeated_windows(found, buckets, length)
    own = packed.withColumn("tag", F.col("uid").bitwiseAND(F.lit(2**32 - 1)))
    return remaining(own.join(gone, ["doc_id", "tag"], "left"))


def remaining(joined: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, starts, stops in zip(*(c.to_pylist() for c in batch.columns)):
                text = coder.decompress(packed)
                own = merged_spans(list(zip(*(np.frombuffer(x or b"", "<u4").tolist() for x in (starts, stops)))))
                digest, at = hashlib.sha256(), 0
                for a, b in own:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((doc_id, len(text), sum(b - a for a, b in own), len(own), digest.hexdigest(), [{"start": a, "stop": b} for a, b in own]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return joined.select("doc_id", "packed", "starts", "stops").mapInArrow(cut, REMOVAL)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(documents(spark, sf_dir)).drop("spans")
