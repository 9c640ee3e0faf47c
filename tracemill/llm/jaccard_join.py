"""Near-duplicate classes by an exact Jaccard join on word shingles, skipping by set relations.

1. A sketch of fixed size counts all shingles; it gives a global order, rare shingles first.
2. Of two sets that link, each one's first fifth (its prefix) shares MET shingles with the other's, at positions that still
   allow the overlap. So prefixes make an inverted index, its lists ordered by set size. In an entry's list all blocks
   are skipped that hold no size and position it could link with (``partnered``); entries without any partner are
   skipped for good, which leaves a few hundredths of them. Equal sets are one node and enter once.
   Sets that are left in fewer than MET lists, and have more shingles, link with none and are skipped with all entries.
3. Of each set there are folded bits, the parities of its shingles by their low bits. Two sets differ in at least as many
   shingles as their bits differ, so most pairs that don't link are skipped before any text is sent for them.
4. Each list has a leader. A set is compared in full with the leaders of most of its lists; sets that link with one
   leader are a class, which answers all pairs among them: no such pair is made. Lists in one class are done with.
5. Lists that still hold several classes are gathered by one of their sets, which lists of nearly the same sets have in
   common, in tiles of bounded size. A task makes a tile's pairs as places of a matrix; those that lists and folded bits leave
   open are answered where the tile meets again with the texts of the sets in question. A set's overlaps with all others are
   derived from those of a similar set, by the shingles in which the two differ. Only links that join classes become rows.
   Nothing is capped: every link is within a class, or its pair is skipped by a bound or answered in a tile.
6. Classes are joined to components.

Lists of shingles far more frequent than others aren't gathered in one task: their entries stay rows, so grouping and
joins by Spark split them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import component_labels
from .shared import among, bounded_batches, by_slices, documents, stored, text_bytes
from .shingles import by_range, mixed, ranged, shingle_set, shingle_sets

CELLS, BLOCKS = 2**20, 64
CELL_SHIFT = np.uint64(44)
FREQUENT = 1000
HELD_ENTRIES = 1_000_000
LEADERS = 2
TILE, TILE_SHINGLES, HOSTS = 256, 500_000, 16
MET = 3
PERCENT = 80
FOLDED_BITS = 2**8, 2**16


def prefix_size(n: int) -> int:
    """So many of the rarest shingles of a set of ``n`` have MET of those that it shares with a set it links with, or all."""
    return min(n, n - -(-PERCENT * n // 100) + MET)


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """The two halves of a 128-bit digest of a set."""
    first, second = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
    return first, second


def folded_bits(shingles: np.ndarray) -> bytes:
    """For each value of the shingles' low bits whether it occurs an odd number of times, as a bit; one to two bits a shingle, in the bounds of FOLDED_BITS."""
    least, most = FOLDED_BITS
    bits = min(most, max(least, 1 << (max(1, len(shingles)) - 1).bit_length()))
    times = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(folded: bytes, size: int) -> np.ndarray:
    """Folded bits of that many bytes, as numbers: halves laid over each other are what one low bit less gives."""
    return np.bitwise_xor.reduce(np.frombuffer(folded, "<u8").reshape(-1, size // 8))


def drop_far(may: np.ndarray, n: np.ndarray, folded: list[bytes]) -> None:
    """Takes from ``may`` the pairs whose folded bits show that they don't link: sets of together s shingles that link differ in at most s / 9 of them."""
    sizes = np.array([len(x) for x in folded])
    for size in np.unique(sizes[may.any(axis=1)]).tolist():
        rows = np.flatnonzero((sizes >= size) & may.any(axis=1))
        level = np.array([fold(folded[r], size) for r in rows.tolist()])
        for k in np.flatnonzero(sizes[rows] == size).tolist():
            x, near = rows[k], np.flatnonzero(may[rows[k], rows])
            differing = np.bitwise_count(level[near] ^ level[k]).sum(axis=1, dtype=np.int64)
            far = rows[near[(100 + PERCENT) * differing > (100 - PERCENT) * (n[x] + n[rows[near]])]]
            may[x, far] = may[far, x] = False


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, node, check, folded of every document: its set's size, digest and folded bits. Rows with a block hold a task's counts of shingles for a part of the sketch."""
    cells, blocks = CELLS, BLOCKS
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("folded", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for a, b in by_slices(batch, 1):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist())
                total += np.bincount(np.concatenate(sets) >> CELL_SHIFT, minlength=cells)
                node, check = zip(*map(node_of, sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, sets), pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(map(folded_bits, sets), pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], schema=schema)
        parts = [zlib.compress(p.astype("<u8").tobytes(), 1) for p in np.split(total, blocks)]
        none = pa.nulls(blocks, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(blocks, pa.binary()), pa.array(range(blocks), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(profile, "doc_id long, n long, node long, check long, folded binary, block int, counts binary")


def cell_counts(profiled: DataFrame) -> np.ndarray:
    """How many shingles fall in each cell of the sketch; tasks' tables are added in two steps, so no task holds them all."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<u8") for x in pdf["counts"])
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    tables = profiled.filter("block IS NOT NULL").select("block", "counts")
    some = tables.groupBy("block", F.pmod(F.xxhash64("counts"), F.lit(256))).applyInPandas(add, "block int, counts binary")
    rows = some.groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), "<u8") for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(CELLS, np.uint64)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A class for each cell, from 0 (rare) to 31: how far its count is above the mean, in quarters of a power of two; plus 32 if it is frequent, far above the mean."""
    mean = max(1.0, float(counts.mean()))
    return np.clip(np.floor(4 * np.log2(np.maximum(counts, 1) / mean)), 0, 31).astype(np.uint8) + (counts > 2 * mean + FREQUENT).astype(np.uint8) * 32


LIST = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("places", pa.binary())])


def compact(values: np.ndarray) -> bytes:
    """Numbers of one, two or four bytes each, as many as the largest needs."""
    most = values.max()
    return values.astype("<u1" if most < 2**8 else "<u2" if most < 2**16 else "<u4").tobytes()


def expanded(held: bytes, times: int) -> np.ndarray:
    """What ``compact`` made of so many numbers."""
    return np.frombuffer(held, f"<u{len(held) // times}").astype(np.int64)


def prefix_lists(docs: DataFrame, classes: np.ndarray, buckets: int) -> DataFrame:
    """LIST: prefixes of many different sets in a range of shingles: nodes, sizes, numbers of entries, shingles (low half), positions. Entries of frequent shingles have no bucket and whole shingles."""
    shipped = docs.sparkSession.sparkContext.broadcast(classes.tobytes())

    def packed(bucket: int | None, own: np.ndarray, owner: np.ndarray, node: np.ndarray, size: np.ndarray, token: np.ndarray, place: np.ndarray) -> tuple:
        some, counts = np.unique(owner[own], return_counts=True)
        tokens = token[own].tobytes() if bucket is None else token[own].astype("<u4").tobytes()
        return bucket, node[some].tobytes(), compact(size[some]), compact(counts), tokens, compact(place[own])

    def lists(sets: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        token = mixed(np.concatenate([x for _, x, _ in sets.values()]))
        often = np.concatenate([f for _, _, f in sets.values()])
        lengths = np.array([len(x) for _, x, _ in sets.values()])
        owner = np.repeat(np.arange(len(sets)), lengths)
        place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        node, size = np.array(list(sets), np.int64), np.array([n for n, _, _ in sets.values()], np.int64)
        bucket = np.where(often, buckets, ranged(token, buckets))
        rows = [packed(k if k < buckets else None, own, owner, node, size, token, place) for k, own in by_range(bucket)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(LIST)], schema=LIST)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(shipped.value, np.uint8)
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        entries = 0
        for batch in batches:
            for a, b in by_slices(batch, 0):
                for x in shingle_sets(batch.column(0).slice(a, b - a).to_pylist()):
                    if not len(x) or (node := node_of(x)[0]) in held:
                        continue
                    own = rank[x >> CELL_SHIFT]
                    ordered = (own & np.uint8(31)).astype(np.uint64) << np.uint64(58) | x & np.uint64(2**58 - 1)
                    k = prefix_size(len(x))
                    first = np.argpartition(ordered, k - 1)[:k] if k < len(x) else np.arange(len(x))
                    first = first[np.argsort(ordered[first])]
                    held[node] = len(x), ordered[first], own[first] >= 32
                    entries += k
                if entries > HELD_ENTRIES:
                    yield lists(held)
                    held, entries = {}, 0
        if held:
            yield lists(held)

    return docs.select(text_bytes().alias("text")).mapInArrow(cut, "bucket int, nodes binary, sizes binary, counts binary, tokens binary, places binary")


def largest_within(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest value at places from ``low`` to below ``high``, or the least number there is where that is none."""
    out = np.full(len(low), np.iinfo(np.int64).min)
    table, width = values, 1
    while (some := high - low >= width).any():
        now = some & (high - low < 2 * width)
        out[now] = np.maximum(table[low[now]], table[high[now] - width])
        if len(table) <= width:
            break
        table, width = np.maximum(table[:-width], table[width:]), 2 * width
    return out


def partnered(token: np.ndarray, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Whether an entry has one in its list that it may link with: sizes a, b where each is at most the other's top. Entries are in order of list and size."""
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    number = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(token)]))
    stop = np.searchsorted(number << 32 | n, number << 32 | np.maximum(top, 0), side="right")
    i = np.arange(len(token))
    return (largest_within(top, i + 1, stop) >= n) | (largest_within(top, begin[number], np.minimum(i, stop)) >= n)


def leading(token: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each entry the place of the one of least ``order`` in its list."""
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[begin, len(token)])
    least = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, begin), length))
    return least[np.searchsorted(least, np.repeat(begin, length))]


ENTRY = "token long, node long, n long, top long, leader long"


def shared_entries(lists: DataFrame, buckets: int) -> DataFrame:
    """ENTRY: all entries that some other entry of their list may link with; top: the largest set they may link with. leader: the set of least position in the list, so with the fewest rare shingles, which a text has that others were copied from. Of frequent shingles all entries, the leader being one of those packed with them."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in ENTRY.split(", ")])

    def entries(held: list) -> Iterator[pa.RecordBatch]:
        bucket = held[0][0]
        node, n, token, pos = [], [], [], []
        for _, nodes, sizes, counts, tokens, places in held:
            own = np.frombuffer(nodes, np.int64)
            times = expanded(counts, len(own))
            node.append(np.repeat(own, times))
            n.append(np.repeat(expanded(sizes, len(own)), times))
            token.append(np.frombuffer(tokens, "<i8") if bucket is None else np.frombuffer(tokens, "<u4").astype(np.int64))
            pos.append(expanded(places, times.sum()))
        node, n, token, pos = map(np.concatenate, (node, n, token, pos))
        order = np.argsort(token, kind="stable")
        if bucket is not None:
            again = token[order][1:] == token[order][:-1]
            order = order[np.r_[False, again] | np.r_[again, False]]
        order = order[np.lexsort((node[order], n[order], token[order]))]
        node, n, token, pos = node[order], n[order], token[order], pos[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])][: len(token)]  # equal sets come from several batches
        node, n, token, pos = node[once], n[once], token[once], pos[once]
        # an overlap of n - pos or less is left, besides MET - 1 shingles; it must be 4/9 of both sizes together
        top = (9 * (n - pos + MET - 1) - 4 * n) // 4
        if bucket is not None and len(token):
            may = partnered(token, n, top)
            node, n, token, pos, top = node[may], n[may], token[may] | bucket << 32, pos[may], top[may]
        if len(token):
            leader = node[leading(token, np.minimum(pos, 2**20 - 1).astype(np.uint64) << np.uint64(44) | mixed(node.view(np.uint64)) >> np.uint64(20))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (token, node, n, top, leader)], schema=schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != row[0] or row[0] is None):
                    yield from entries(held)
                    held = []
                held.append(row)
        if held:
            yield from entries(held)

    place = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("nodes"), F.lit(buckets)).cast("int"))
    return lists.repartitionById(buckets, place).sortWithinPartitions("bucket").mapInArrow(gather, ENTRY)


def among_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose ``node`` is in ``nodes``, and a few others."""
    return among(rows.withColumnRenamed("node", "doc"), nodes.select(F.col("node").alias("doc"))).withColumnRenamed("doc", "node")


def meeting(entries: DataFrame) -> DataFrame:
    """node of the sets with MET entries, or as many as shingles. No others link with any."""
    return entries.groupBy("node", "n").agg(F.count("*").alias("lists")).filter(F.col("lists") >= F.least(F.lit(MET), "n")).select("node")


def set_bits(profiled: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, folded of the sets in ``nodes`` and a few others."""
    return among_nodes(profiled.filter("doc_id IS NOT NULL AND n > 0").select("node", "n", "folded"), nodes).groupBy("node").agg(F.first("n").alias("n"), F.first("folded").alias("folded"))


def likely(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs a, b of sets with folded bits that these don't rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                size = min(len(x), len(y))
                differing = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                keep.append((100 + PERCENT) * differing <= (100 - PERCENT) * (na + nb))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(bits.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("folded").alias(f"f{side}")), side)
    return pairs.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(near, "a long, b long")


def most_led(entries: DataFrame) -> DataFrame:
    """a, b: each set with the sets that lead most of its lists, if they lead an eighth of its prefix."""
    counted = entries.filter("node <> leader").groupBy("node", "leader", "n").agg(F.count("*").alias("lists")).filter("lists * 40 >= n")
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("lists"), "leader"))
    return counted.withColumn("turn", turn).filter(F.col("turn") <= LEADERS).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def packed_sets(docs: DataFrame, profiled: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, packed of the sets in ``nodes`` and a few others: the compressed text, less than half the size of its shingles."""
    wanted = stored(profiled.filter("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("doc")).join(nodes, "node", "left_semi"), "wanted")
    schema = pa.schema([("node", pa.int64()), ("packed", pa.binary())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b in by_slices(batch, 1):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                nodes = [node_of(x)[0] for x in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(coder.compress, texts), pa.binary())], schema=schema)

    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    some = among(named, wanted.select("doc")).select("doc", text_bytes().alias("text")).mapInArrow(take, "node long, packed binary")
    return some.groupBy("node").agg(F.first("packed").alias("packed"))


def either(pairs: DataFrame) -> DataFrame:
    """node: the sets of the pairs a, b."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


ANSWER = "a long, b long, na long, nb long, common long"


def answers(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """ANSWER of each pair a, b: the sizes and the overlap of the two sets.

    Pairs are dealt to tiles by groups of sets on either side; a set is sent to each tile that has a pair with it, once, however many
    pairs those are, and taken apart there once.
    """
    schema = pa.schema([(c.split()[0], pa.int64()) for c in ANSWER.split(", ")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        at, held = None, {}
        for batch in batches:
            out = []
            for tile, a, b, packed in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if tile != at:
                    at, held = tile, {}
                if packed is not None:
                    held[a] = shingle_set(coder.decompress(packed))
                elif a in held and b in held:
                    x, y = held[a], held[b]
                    out.append((a, b, len(x), len(y), np.intersect1d(x, y, assume_unique=True).size))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, schema=schema)

    nodes = either(pairs).withColumnRenamed("node", "doc")
    groups = max(1, nodes.count() // TILE)
    own = lambda x: F.pmod(F.xxhash64(x), F.lit(groups))
    tiled = pairs.select((own("a") * groups + own("b")).alias("tile"), "a", "b")
    needed = tiled.select("tile", F.col("a").alias("node")).unionByName(tiled.select("tile", F.col("b").alias("node"))).distinct()
    # sets that no pair has aren't shuffled
    sets = among(sets.withColumnRenamed("node", "doc"), nodes).withColumnRenamed("doc", "node")
    sent = needed.join(sets, "node").select("tile", F.lit(0).alias("turn"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    asked = tiled.select("tile", F.lit(1).alias("turn"), "a", "b", F.lit(None).cast("binary").alias("packed"))
    return sent.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "turn").mapInArrow(compare, ANSWER)


NEEDED = f"({PERCENT} * (na + nb) + {99 + PERCENT}) div {100 + PERCENT}"
LINKED = f"100 * common >= {PERCENT} * (na + nb - common)"


def with_labels(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their class, of the lists that have several, and the list's home: one of its sets, mostly the same for lists of nearly the same sets."""
    labelled = entries.select("token", "node", "n", "top").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lists = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("node"), "node")).alias("h"))
    return labelled.join(lists.filter("low < high").select("token", F.col("h.node").alias("home")), "token")


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after ``links`` between nodes: components of the classes so far."""
    if labels is None:
        return stored(component_labels(links), "labels")
    named = links
    for side in "ab":
        named = named.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    more = component_labels(named.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("further"))
    old = labels.join(more, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    # classes of one set so far have no row among the labels
    new = more.select(F.col("label").alias("node"), F.col("further").alias("label")).join(labels, "node", "left_anti")
    return stored(old.unionByName(new), "labels")


def tiled(crossing: DataFrame) -> DataFrame:
    """tile, part, node, label, n, tokens, tops: what a set's entries are in the lists of one home, once for each tile of pairs it is in.

    A home with few sets is one tile, one with many is cut: its sets are dealt to parts, and each two parts are a tile. Sets in fewer
    than MET lists of several classes go.
    """
    found = stored(crossing.groupBy("home", "node", "label", "n").agg(F.collect_list(F.struct("token", "top")).alias("met")), "met")
    enough = found.groupBy("node", "n").agg(F.sum(F.size("met")).alias("lists")).filter(F.col("lists") >= F.least(F.lit(MET), "n"))
    homes = stored(found.join(enough.select("node"), "node", "left_semi"), "homes")
    parts = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("long").alias("parts"), F.min("label").alias("low"), F.max("label").alias("high"))
    dealt = homes.join(parts.filter("low < high").select("home", "parts"), "home")
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit("part"), "node"), "parts")).otherwise(F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tile = F.struct("home", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return dealt.select(tile.alias("tile"), "part", "node", "label", "n", F.col("met.token").alias("tokens"), F.col("met.top").alias("tops"))


def within(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + length, length)


def possible(part: np.ndarray, label: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], tops: list[np.ndarray], apart: bool) -> np.ndarray:
    """For each two sets whether they are of different classes (and parts, if ``apart``) and meet in a list at places that leave the needed overlap possible."""
    lengths = np.array([len(t) for t in tokens])
    token, top, row = np.concatenate(tokens), np.concatenate(tops), np.repeat(np.arange(len(n)), lengths)
    order = np.argsort(token, kind="stable")
    token, top, row = token[order], top[order], row[order]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[begin, len(token)])
    after = np.repeat(begin + length, length) - np.arange(len(token)) - 1
    may = np.zeros((len(n), len(n)), bool)
    # at most a list's length more than HELD_ENTRIES pairs at once
    for some in np.split(np.arange(len(token)), np.flatnonzero(np.diff(np.cumsum(after) // HELD_ENTRIES)) + 1):
        p, q = np.repeat(some, after[some]), within(some + 1, after[some])
        a, b = row[p], row[q]
        fit = (n[a] <= top[q]) & (n[b] <= top[p]) & (label[a] != label[b])
        if apart:
            fit &= part[a] != part[b]
        may[a[fit], b[fit]] = True
    return may | may.T


def joining_links(label: np.ndarray, n: np.ndarray, sets: list[np.ndarray], may: np.ndarray) -> list[tuple[int, int]]:
    """Links between places among ``may`` that join all classes that these join.

    A set's overlaps with all others are derived from those of a similar set answered before: less where the others have what
    it lacks, more where they have what it has beyond. Only sets unlike all answered ones are counted from scratch.
    """
    lengths = np.array([len(x) for x in sets])
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    several = times[ids] > 1  # what only one set has is in no overlap
    ids, row = ids[several], row[several]
    own = np.split(ids, np.cumsum(np.bincount(row, minlength=len(sets)))[:-1])
    holders = row[np.argsort(ids, kind="stable")]
    number = np.where(times > 1, times, 0)
    first = np.cumsum(number) - number

    def having(shingles: np.ndarray) -> np.ndarray:
        return np.bincount(holders[within(first[shingles], number[shingles])], minlength=len(sets))

    label, out, answered = label.copy(), [], []
    for x in np.flatnonzero(may.any(axis=1)).tolist():
        asked = may[x] & (label != label[x])
        if not asked.any():
            continue
        near = min(answered, key=lambda a: len(own[a[0]]) - 2 * a[1][x], default=None)
        if near and len(own[near[0]]) - 2 * near[1][x] < 0:
            host, common = near
            common = common + having(np.setdiff1d(own[x], own[host], assume_unique=True)) - having(np.setdiff1d(own[host], own[x], assume_unique=True))
        else:
            common = having(own[x])
            if len(answered) < HOSTS:
                answered.append((x, common))
        for y in np.flatnonzero(asked & (100 * common >= PERCENT * (n + n[x] - common))).tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def by_tile(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[tuple[tuple[int, int, int], list[tuple]]]:
    """Each tile with its rows, without the three columns that name it. The last ``lists`` columns are lists of numbers."""
    at, held = None, []
    for batch in batches:
        plain = batch.num_columns - lists
        numbers = [batch.column(k) for k in range(plain, batch.num_columns)]
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(plain)))):
            if row[:3] != at:
                if held:
                    yield at, held
                at, held = row[:3], []
            held.append((*row[3:], *(c[k].values.to_numpy(zero_copy_only=False) for c in numbers)))
    if held:
        yield at, held


OPEN = "home long, i long, j long, place int, node long, label long, n long, may binary"


def open_pairs(crossing: DataFrame, bits: DataFrame, buckets: int) -> DataFrame:
    """OPEN: the sets of each tile that have a pair there which neither lists nor folded bits rule out; the pairs as bits by the place of the other set."""
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in OPEN.split(", ")])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, held in by_tile(batches, 2):
            part, node, label, n = (np.array(c, np.int64) for c in list(zip(*held))[:4])
            may = possible(part, label, n, [r[5] for r in held], [r[6] for r in held], at[1] != at[2])
            drop_far(may, n, [r[4] for r in held])
            some = np.flatnonzero(may.any(axis=1))
            if len(some):
                rows = [x.tobytes() for x in np.packbits(may[np.ix_(some, some)], axis=1)]
                named = [pa.array([k] * len(some), pa.int64()) for k in at]
                yield pa.RecordBatch.from_arrays([*named, pa.array(range(len(some)), pa.int32()), *(pa.array(c[some]) for c in (node, label, n)), pa.array(rows, pa.binary())], schema=schema)

    dealt = tiled(crossing).join(bits.select("node", "folded"), "node").select("tile.*", "part", "node", "label", "n", "folded", "tokens", "tops")
    return dealt.repartition(buckets, "home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(screen, OPEN)


def crossing_links(pairs: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """a, b: links among the OPEN ``pairs`` that join all classes which links join. Pairs are made in the tasks of their tiles only, and no rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for _, held in by_tile(batches, 0):
            place, node, label, n = (np.array(c, np.int64) for c in list(zip(*held))[:4])
            may = np.array([np.unpackbits(np.frombuffer(r[4], np.uint8))[place] for r in held]).astype(bool)
            found = joining_links(label, n, [shingle_set(coder.decompress(r[5])) for r in held], may)
            if found:
                x, y = node[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    dealt = pairs.join(sets, "node").select("home", "i", "j", "place", "node", "label", "n", "may", "packed")
    return dealt.repartition(buckets, "home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(gather, "a long, b long")


def derived(pairs: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b, na, nb): derived from the answers of the leaders that the two sets link with, or where these leave it open compared.

    A set shares with another at most what their leaders share, and what each has beyond its leader; and at least
    what the leaders share, less what each lacks of its leader.
    """
    linked = known.filter(LINKED)
    sides = linked.select(F.col("a").alias("node"), F.col("b").alias("host"), F.col("na").alias("n"), F.col("nb").alias("m"), "common").unionByName(linked.select(F.col("b").alias("node"), F.col("a").alias("host"), F.col("nb").alias("n"), F.col("na").alias("m"), "common"))
    # leaders are in many answers: a set's host is the one with most of them, itself included
    times = sides.groupBy("host").agg(F.count("*").alias("times"))
    led = sides.join(times, "host").groupBy("node").agg(F.max(F.struct("times", "common", "host", (F.col("n") - F.col("common")).alias("beyond"), (F.col("m") - F.col("common")).alias("lacking"))).alias("h"))
    own = times.select(F.col("host").alias("node"), F.struct("times", F.lit(2**40).alias("common"), F.col("host"), F.lit(0).cast("long").alias("beyond"), F.lit(0).cast("long").alias("lacking")).alias("h"))
    hosts = led.unionByName(own).groupBy("node").agg(F.max("h").alias("h"))
    for side in "ab":
        pairs = pairs.join(hosts.select(F.col("node").alias(side), F.col("h").alias(f"h{side}")), side, "left")
        pairs = pairs.withColumn(f"{side}_host", F.coalesce(f"h{side}.host", side)).withColumn(f"{side}_beyond", F.coalesce(f"h{side}.beyond", F.lit(0))).withColumn(f"{side}_lacking", F.coalesce(f"h{side}.lacking", F.lit(0)))
    pairs = stored(pairs.select("a", "b", "na", "nb", "a_host", "b_host", (F.col("a_beyond") + F.col("b_beyond")).alias("beyond"), (F.col("a_lacking") + F.col("b_lacking")).alias("lacking"), F.least("a_host", "b_host").alias("low"), F.greatest("a_host", "b_host").alias("high")), "crossing-pairs")
    leaders = stored(answers(pairs.filter("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct(), sets), "leader-answers")
    bounded = pairs.join(leaders.select(F.col("a").alias("low"), F.col("b").alias("high"), "common"), ["low", "high"], "left")
    need = F.expr(NEEDED)
    judged = bounded.withColumn("verdict", F.when(F.col("common") + F.col("beyond") < need, 0).when(F.col("common") - F.col("lacking") >= need, 1))
    judged = stored(judged.filter("verdict IS NULL OR verdict = 1").select("a", "b", "verdict"), "verdicts")
    compared = answers(judged.filter("verdict IS NULL").select("a", "b"), sets).filter(LINKED)
    return judged.filter("verdict = 1").select("a", "b").unionByName(compared.select("a", "b"))


def joined_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The profiles of ``docs``; node, label of sets that link with others; and a, b of the links that join them."""
    bounded_batches(docs)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    profiled = stored(profiles(docs), "profiles")
    lists = prefix_lists(docs.filter("doc_id IS NOT NULL"), rarity(cell_counts(profiled)), buckets)
    entries = stored(shared_entries(lists, buckets), "entries")
    nodes = stored(meeting(entries), "nodes")
    bits = stored(set_bits(profiled, nodes), "bits")
    led = stored(likely(most_led(entries), bits), "led")
    known = stored(answers(led, packed_sets(docs, profiled, either(led))), "answers")
    labels = relabelled(None, known.filter(LINKED))
    crossing = stored(with_labels(among_nodes(entries, nodes), labels), "crossing")
    pairs = stored(open_pairs(crossing, bits, buckets), "open")
    last = stored(crossing_links(pairs, packed_sets(docs, profiled, pairs.select("node").distinct()), buckets), "links")
    if not last.isEmpty():
        labels = relabelled(labels, last)
    return profiled, labels, known.filter(LINKED).select("a", "b").unionByName(last)


def least_documents(profiled: DataFrame) -> DataFrame:
    """node, check and the least doc_id of each set."""
    return profiled.filter("doc_id IS NOT NULL AND n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Null or blank texts have no shingles and link with nothing. Rows with a null doc_id have a null component and take
    part in no link. Rows that repeat a doc_id are judged each by its own text, so they may be in several components.
    Texts count whole, however long. An empty table gives none. Other columns aren't read.
    """
    profiled, labels, _ = joined_sets(docs)
    joined = least_documents(profiled).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = joined.join(joined.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "check", "component_id")
    rows = profiled.filter("block IS NULL").select("doc_id", "n", "node", "check").join(joined, ["node", "check"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representative_links(docs: DataFrame) -> DataFrame:
    """doc_a, doc_b: the links that join the components of near_duplicates, each between the least documents of two different sets.

    They reach every set that links with another, with its class's leader or across classes. Other links within a class
    of sets that share a leader aren't listed: near_duplicates has the membership. Odd rows as there.
    """
    profiled, _, links = joined_sets(docs)
    named = stored(least_documents(profiled).groupBy("node").agg(F.min("least").alias("least")), "least")
    for side in "ab":
        links = links.join(named.select(F.col("node").alias(side), F.col("least").alias(f"doc_{side}")), side)
    return links.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).distinct()


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
