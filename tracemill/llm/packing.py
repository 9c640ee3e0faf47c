"""Best-fit packing with a swap-based local search.

Documents become pieces of at most ``size`` tokens. Full pieces are sequences of their own. The others are dealt out
into groups of about ``GROUP`` pieces, whatever the corpus size. A group is packed best-fit in falling order; then
moves, one-for-one and two-for-one exchanges between underfull bins make fuller bins fuller (each step raises the sum
of squared fills) until bins run empty. Bins that stay less than ``AGAIN`` full are dealt out and packed once more, so
that what groups leave over meets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordBpe, per_text, tokenizer_file
from .shared import documents, stored

SIZE = 2048
GROUP = 8192
AGAIN = 0.97
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, file: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; null text is empty and has the end id alone."""

    def cut(coder: WordBpe, doc_id, chunks: list[bytes]) -> Iterator[tuple]:
        ids = coder.ids(chunks) + END
        for k, at in enumerate(range(0, len(ids), 4 * size)):
            own = ids[at : at + 4 * size]
            yield doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)

    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return per_text(docs, WordBpe, file, PIECES, arrow, cut)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def local_search(lengths: list[int], bins: list[list[int]], size: int) -> list[list[int]]:
    """Exchanges between underfull bins until none raises the sum of squared fills or as few bins as can be are left."""
    least = -(-sum(lengths) // size)
    full = [b for b in bins if sum(lengths[i] for i in b) == size]
    under = [b for b in bins if sum(lengths[i] for i in b) < size]
    better = True
    while better and len(full) + len(under) > least:
        better = False
        under.sort(key=lambda b: sum(lengths[i] for i in b))
        fill = np.array([sum(lengths[i] for i in b) for b in under])
        for k in range(len(under)):
            while under[k] and improve(lengths, under, fill, k, size):
                better = True
        under = [b for b in under if b]
        full += [b for b in under if sum(lengths[i] for i in b) == size]
        under = [b for b in under if sum(lengths[i] for i in b) < size]
    return full + under


def improve(lengths: list[int], bins: list[list[int]], fill: np.ndarray, k: int, size: int) -> bool:
    """One exchange that moves tokens from bin ``k`` to a bin at least as full, if there is one; the tightest is taken."""
    room = size - fill
    others = (fill >= fill[k]) & (fill > 0)
    others[k] = False
    for i in sorted(bins[k], key=lambda i: -lengths[i]):
        left = np.where(others, room - lengths[i], size + 1)
        left[left < 0] = size + 1
        to = int(left.argmin()) if len(left) else 0
        if left[to] <= size:
            bins[k].remove(i)
            bins[to].append(i)
            fill[k] -= lengths[i]
            fill[to] += lengths[i]
            return True
    owner, back, gain = exchangeable(lengths, bins, others & (room > 0))
    if not len(owner):
        return False
    for i in sorted(bins[k], key=lambda i: -lengths[i]):
        moved = lengths[i] - gain
        left = np.where((moved > 0) & (moved <= room[owner]) & (fill[owner] + moved > fill[k]), room[owner] - moved, size + 1)
        best = int(left.argmin())
        if left[best] <= size:
            to, given = int(owner[best]), back[best]
            bins[k].remove(i)
            bins[to] = [j for j in bins[to] if j not in given] + [i]
            bins[k].extend(given)
            fill[k] -= moved[best]
            fill[to] += moved[best]
            return True
    return False


def exchangeable(lengths: list[int], bins: list[list[int]], which: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]], np.ndarray]:
    """Bin, items and total length of every item and pair of items that the bins of ``which`` could give."""
    owner, items, total = [], [], []
    for b in np.flatnonzero(which).tolist():
        own = bins[b]
        for x, i in enumerate(own):
            owner.append(b)
            items.append((i,))
            total.append(lengths[i])
            for j in own[x + 1 :]:
                owner.append(b)
                items.append((i, j))
                total.append(lengths[i] + lengths[j])
    return np.array(owner, np.int64), items, np.array(total, np.int64)


def grouped(rest: DataFrame, size: int, turn: int) -> DataFrame:
    """Packs ``rest`` group by group: its columns with sequence_id, offset and the sequence's fill."""
    groups = max(1, -(-rest.count() // GROUP))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].tolist()
        bins = local_search(lengths, best_fit(lengths, size), size)
        at = np.zeros((3, len(pdf)), np.int64)
        # a group has less than 2^20 sequences; groups of both turns take turns
        base = (2 * int(pdf["deal"].iloc[0]) + turn) * 2**20
        for k, own in enumerate(bins):
            place = 0
            for i in own:
                at[:2, i] = base + k, place
                place += lengths[i]
            at[2, own] = place
        return pdf.drop(columns="deal").assign(sequence_id=at[0], offset=at[1], fill=at[2])

    dealt = rest.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    return stored(dealt.groupBy("deal").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long, fill long"), f"packed{turn}")


def pack_documents(docs: DataFrame, file: str, size: int = SIZE) -> DataFrame:
    """PIECES and sequence_id, offset of every piece of ``docs``. Repeated rows are packed each; an empty table gives none."""
    cut = stored(pieces(docs, file, size), "pieces")
    own = [F.col(c.split()[0]) for c in PIECES.split(", ")]
    full = cut.filter(F.col("length") == size).select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = grouped(cut.filter(F.col("length") < size), size, 0)
    done, again = F.col("fill") >= AGAIN * size, F.col("fill") < AGAIN * size
    second = grouped(first.filter(again).select(*own), size, 1)
    results = [*own, F.col("sequence_id"), F.col("offset")]
    return full.unionByName(first.filter(done).select(*results)).unionByName(second.select(*results))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file())
