"""Best-fit packing of documents into token sequences by bin completion."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.llm.common import tidied, written
from archipel.llm.token_memo import memo, text_slices

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, where asked for).

    A document is its ids and then `end_id`; null texts are empty. Only documents longer
    than `size` are cut, from the end, so that just the first piece may be shorter.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = memo(tokenizer)
        for batch in tidied(batches):
            for part in text_slices(batch, 1, 2 << 20):
                ids, number, start, length, crc, raw = [], [], [], [], [], []
                tokens, begins = encode.encode(part.column(1))
                for i, doc in enumerate(part.column(0).to_pylist()):
                    all_ids = np.append(tokens[begins[i] : begins[i + 1]], encode.dtype.type(end_id)).astype("<u4")
                    first = len(all_ids) % size or size
                    for n, lo in enumerate([0, *range(first, len(all_ids), size)]):
                        hi = lo + size if n else first
                        piece = all_ids[lo:hi].tobytes()
                        ids.append(doc)
                        number.append(n)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            raw.append(piece)
                columns = [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, _PIECES + (", ids binary" if with_ids else ""))


class Fillings:
    """What can fill a bin from a histogram of lengths (falling), in a fixed order: fullest first, then longest items first.

    Which sums are reachable from the i-th length on is kept as bits of a number, so only
    fillings that exist are ever entered.
    """

    def __init__(self, lengths: list[int], counts: list[int], room: int):
        self.lengths, self.room = lengths, room
        mask = (1 << room + 1) - 1
        self.reach = [1]
        for length, count in zip(reversed(lengths), reversed(counts), strict=True):
            bits, left, step = self.reach[-1], min(count, room // length), 1
            while left:  # 1, 2, 4, ... of a length, and the rest
                step = min(step, left)
                bits |= bits << step * length & mask
                left, step = left - step, step * 2
            self.reach.append(bits)
        self.reach.reverse()

    def of(self, total: int, left: list[int], i: int = 0) -> Iterator[list[int]]:
        """Fillings of exactly `total` from what is `left`: indices of lengths, rising."""
        if not total:
            yield []
        while total and i < len(left) and self.reach[i] >> total & 1:
            for times in range(min(left[i], total // self.lengths[i]), 0, -1):
                for rest in self.of(total - times * self.lengths[i], left, i + 1):
                    yield [i] * times + rest
            i += 1


def dominated(filling: list[int], waste: int, lengths: list[int], left: list[int]) -> bool:
    """Whether an unused piece fits beside the filling or could stand in for one, two or three of its pieces: such a filling is never needed.

    The piece is as long as those together or longer (longer than a single one), and what
    it replaces fits where it came from. `left` is what the filling leaves over.
    """
    unused = [x for x, n in zip(reversed(lengths), reversed(left), strict=True) if n]

    def between(lo: int, hi: int) -> bool:
        at = bisect_left(unused, lo)
        return at < len(unused) and unused[at] <= hi

    if waste and between(0, waste):
        return True
    own = [x for i in dict.fromkeys(filling) for x in [lengths[i]] * min(3, filling.count(i))]
    most = 3 if len(own) <= 12 else 2 if len(own) <= 40 else 1
    return any(between(sum(some) + (n == 1), sum(some) + waste) for n in range(1, most + 1) for some in set(combinations(own, n)))


def least_bins(lengths: list[int], counts: list[int], size: int) -> int:
    """A lower bound: pieces over a bin less k are alone, those over half a bin share none, and the rest fill what these leave."""
    best = -(-sum(x * c for x, c in zip(lengths, counts, strict=True)) // size)
    for k in {0, *(x for x in lengths if 2 * x <= size)}:
        alone = sum(c for x, c in zip(lengths, counts, strict=True) if x > size - k)
        half = [(x, c) for x, c in zip(lengths, counts, strict=True) if size - k >= x and 2 * x > size]
        small = sum(x * c for x, c in zip(lengths, counts, strict=True) if k <= x and 2 * x <= size)
        free = sum((size - x) * c for x, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - free) // size)))
    return best


def best_fit(lengths: list[int], counts: list[int], size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over the histogram: [(indices of a filling, times)]. Equal bins are one entry, so its work does not grow with the pieces."""
    by_free: dict[int, list[list]] = {}  # free room -> [filling, times]
    frees: list[int] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        while count:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                entry = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free], frees[at]
                fits = free // length
                times = min(entry[1], max(1, count // fits))
                used = min(fits, count)
                if times < entry[1]:
                    by_free.setdefault(free, []).append([entry[0], entry[1] - times])
                    if free not in frees:
                        insort(frees, free)
                filling = entry[0]
            else:
                fits = size // length
                used = min(fits, count)
                times, filling, free = max(1, count // fits), [], size
            count -= used * times
            rest = free - used * length
            if rest not in by_free:
                by_free[rest] = []
                insort(frees, rest)
            by_free[rest].append([filling + [i] * used, times])
    return [(filling, times) for entries in by_free.values() for filling, times in entries]


@dataclass(frozen=True)
class Plan:
    """[(lengths in a sequence, longest first; times)], the bound on how few sequences there can be, and whether the search ended by itself."""

    fillings: list[tuple[list[int], int]]
    bound: int
    finished: bool

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.fillings)


def complete_bins(lengths: list[int], counts: list[int], size: int = 2048, nodes: int = 20_000) -> Plan:
    """Bin completion by branch and bound over how many pieces have each length, at most `size` numbers whatever the corpus.

    Best fit gives the incumbent. Each node takes the longest piece left and branches over
    the undominated fillings around it, fullest first, and over how many bins get that
    filling; bins around equal pieces come in a fixed order, so no plan is met twice. A
    branch whose waste exceeds what a plan better than the incumbent may waste is cut, and
    the search ends when the incumbent meets the lower bound. Left to itself it is exact.
    Packing is NP-hard, so it ends once `nodes` nodes and fillings were met, with the best plan it
    has; `finished` tells, and `sequences - bound` how far from the optimum it can be.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes, left = [int(lengths[i]) for i in order], [int(counts[i]) for i in order]
    sizes, left = [x for x, c in zip(sizes, left, strict=True) if c], [c for c in left if c]
    bound, best = least_bins(sizes, left, size), best_fit(sizes, left, size)
    used, visited = sum(t for _, t in best), 0
    plan: list[tuple[list[int], int]] = []

    def options(top: int, after: tuple, slack: int) -> Iterator[tuple[int, list[int]]]:
        """(waste, filling) around the piece `top`, in order, beyond `after`."""
        nonlocal visited
        room = size - sizes[top]
        table = Fillings(sizes, left, room)
        for waste in range(after[0], min(room, slack) + 1):
            for filling in table.of(room - waste, left):
                visited += 1
                if (waste, filling) > after:
                    yield waste, filling
                elif visited >= nodes:
                    return

    def node(bins: int, rest: int, top: int, after: tuple) -> Iterator[Iterator]:
        """Tries what is left, `rest` in all, with `bins` filled before; gives the nodes below to the loop that runs them."""
        nonlocal best, used, visited
        visited += 1
        while top < len(left) and not left[top]:
            top, after = top + 1, (0, [])
        if top == len(left):
            if bins < used:
                best, used = list(plan), bins
            return
        left[top] -= 1
        for waste, filling in options(top, after, (used - 1 - bins) * size - rest):
            slack = (used - 1 - bins) * size - rest  # what a better plan may still waste
            if waste > slack or used <= bound or visited >= nodes:
                break
            for i in filling:
                left[i] -= 1
            worse = dominated(filling, waste, sizes, left)
            for i in filling:
                left[i] += 1
            if worse:
                continue
            left[top] += 1
            whole = [top, *filling]
            need = Counter(whole)
            times = min(left[i] // n for i, n in need.items())
            for t in range(min(times, slack // waste) if waste else times, 0, -1):
                for i, n in need.items():
                    left[i] -= n * t
                plan.append((whole, t))
                yield node(bins + t, rest - t * (size - waste), top, (waste, filling))
                plan.pop()
                for i, n in need.items():
                    left[i] += n * t
                if used <= bound or visited >= nodes:
                    break
            left[top] -= 1
        left[top] += 1

    total = sum(x * c for x, c in zip(sizes, left, strict=True))
    if used > bound:
        stack = [node(0, total, 0, (0, []))]
        while stack:  # a stack of our own: plans may be thousands of bins deep
            deeper = next(stack[-1], None)
            if deeper is None:
                stack.pop()
            else:
                stack.append(deeper)
    return Plan([([sizes[i] for i in sorted(filling)], times) for filling, times in best], bound, used <= bound or visited < nodes)


def pack(pieces: DataFrame, size: int = 2048, nodes: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (doc_id, piece, length and more).

    The number of pieces of each length (at most `size` rows) is all that the driver sees.
    It plans fillings for those counts; every piece then finds its place by its rank among
    the pieces of its length. Ranks come from hashed groups of bounded size and the prefix
    sums of their counts, so that a length which a third of all pieces share is no hot
    spot. Equal rows rank arbitrarily. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    groups = max(64, pieces.count() // 50_000)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    totals = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    totals = totals.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).drop("n")
    by_length = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    runs, sequence = [], 0
    for chosen, times in complete_bins([r["length"] for r in by_length], [r["n"] for r in by_length], size, nodes).fillings:
        offset = 0
        for length in dict.fromkeys(chosen):
            slots = chosen.count(length)
            runs.append((length, slots, times, sequence, offset))
            offset += slots * length
        sequence += times
    taken: dict[int, int] = {}
    rows = []
    for length, slots, times, first, offset in runs:
        lo = taken.get(length, 0)
        taken[length] = lo + slots * times
        rows.append((length, lo, taken[length], slots, first, offset))
    places = spark.createDataFrame(rows, "length long, lo long, hi long, slots long, first long, at long")
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__within", within).join(totals, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__within"))
    placed = ranked.join(F.broadcast(places), "length").where((F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    mine = F.col("__rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.floor(mine / F.col("slots"))).cast("long").alias("sequence_id"),
        (F.col("at") + mine % F.col("slots") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, nodes: int = 20_000) -> DataFrame:
    """Packs `docs` into as few sequences of at most `size` tokens as bin completion finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece.
    Null and empty texts are one end id; a text of any length is tokenized whole and cut
    into pieces. Rows of repeated or null ids are documents of their own; pieces of one
    length are interchangeable, so ties only decide which of them lies where. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    return pack(cut_pieces(docs, tokenizer, size, end_id), size, nodes)
