"""A hierarchical Pitman-Yor language model: restaurants of words given the words before, seated by Gibbs sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipel.llm.common import drop_written, tidied, tidy, width_for, written, written_in_buckets
from archipel.llm.minhash import word_hashes
from archipel.llm.token_memo import text_slices

#: Words are told apart by the upper 48 bits of their hash.
CUT = np.uint64(16)
#: The end of a text, which also stands before its first word: the hash of the empty word.
END = np.uint64(0x2D06800538D394C2) >> CUT


@dataclass(frozen=True)
class Hierarchy:
    """`words`: one or two words of context. `exact`: up to so many customers a dish's tables are drawn from their exact conditional distribution."""

    words: int = 1
    burn_in: int = 2
    samples: int = 4
    strength: float = 1.0
    exact: int = 48
    seed: int = 5


def stirling(most: int, discount: float) -> np.ndarray:
    """log S(c, t): the log weight of all ways in which c customers take t tables, by the recurrence over the last customer."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            joins = np.where(t <= c, out[c, 1:] + np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], joins)
    return out


def seat(counts: np.ndarray, new: np.ndarray, per_table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables the `counts` customers of each dish take, seated one after another.

    With n seated at t tables the next customer opens a table with weight new + per_table * t
    against n - discount * t. All dishes are seated side by side; from the 48th customer on,
    in groups that grow with n, so a dish of any size takes few steps.
    """
    tables = np.minimum(counts, 1).astype(np.float64)
    n, left = 1, np.flatnonzero(counts > 1)
    while len(left):
        group = np.minimum(max(1, n // 16) if n >= 48 else 1, counts[left] - n)
        opening = new[left] + per_table[left] * tables[left]
        chance = opening / (opening + n - discount * tables[left])
        tables[left] += rng.binomial(group, np.clip(chance, 0, 1))
        n += max(1, n // 16) if n >= 48 else 1
        left = left[counts[left] > n]
    return tables


def reseat(counts: np.ndarray, others: np.ndarray, above: np.ndarray, discount: float, how: Hierarchy, rng: np.random.Generator) -> np.ndarray:
    """A Gibbs step for every dish: all its customers leave and its tables are drawn anew, given the `others` of its restaurant.

    The weight of t tables is S(c, t) * above ** t * prod(strength + discount * (others + i), i < t).
    Dishes of more than `how.exact` customers are seated in turn by `seat`.
    """
    tables = np.minimum(counts, 1).astype(np.float64)
    ways = stirling(how.exact, discount)
    order = np.argsort(counts, kind="stable")
    edge = np.searchsorted(counts[order], np.arange(2, how.exact + 2))
    for c, lo, hi in zip(range(2, how.exact + 1), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        step = max(1, (1 << 18) // c)
        for at in range(lo, hi, step):
            own = order[at : min(hi, at + step)]
            more = np.log(how.strength + discount * (others[own, None] + np.arange(c))) + np.log(above[own, None])
            weight = ways[c, 1 : c + 1] + np.cumsum(more, axis=1)
            tables[own] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    many = order[edge[-1] :]
    if len(many):
        new = (how.strength + discount * others[many]) * above[many]
        tables[many] = seat(counts[many], new, discount * above[many], discount, rng)
    return tables


class Restaurants:
    """The restaurants of one word of context, and those of two words, whose parents they are.

    Cells are (context, word) of the longest contexts, numbered by `ctx2`; `pair` gives each
    cell's (last word of context, word), `ctx1` each pair's context. `below` is the unigram
    probability of every pair's word. With one word of context, cells are pairs.
    """

    def __init__(self, cells: dict[str, np.ndarray], discounts: tuple[float, float], how: Hierarchy, rng: np.random.Generator):
        self.c2, self.pair, self.ctx2, self.ctx1 = cells["count"], cells["pair"], cells["ctx2"], cells["ctx1"]
        self.n2, self.n1 = int(self.ctx2.max(initial=-1)) + 1, int(self.ctx1.max(initial=-1)) + 1
        self.discounts, self.how, self.rng = discounts, how, rng
        self.t2 = np.minimum(self.c2, 1).astype(np.float64) if how.words > 1 else self.c2
        self.t1 = np.minimum(self._sent(), 1).astype(np.float64)

    def _sent(self) -> np.ndarray:
        """The tables of two-word contexts are the customers of their parents; without them the tokens are."""
        return self.c2 if self.how.words == 1 else np.bincount(self.pair, weights=self.t2, minlength=len(self.ctx1)).astype(np.int64)

    def _others(self, tables: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(context, weights=tables, minlength=n)[context] - tables

    def _chance(self, counts, tables, context, n, above, discount) -> np.ndarray:
        total, seated = (np.bincount(context, weights=x, minlength=n)[context] for x in (counts, tables))
        s = self.how.strength
        return (counts - discount * tables + (s + discount * seated) * above) / (s + total)

    def chances(self, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predictive probabilities of all pairs and of all cells under the present seating."""
        d2, d1 = self.discounts
        one = self._chance(self._sent(), self.t1, self.ctx1, self.n1, below, d1)
        if self.how.words == 1:
            return one, one
        return one, self._chance(self.c2, self.t2, self.ctx2, self.n2, one[self.pair], d2)

    def sweep(self, below: np.ndarray) -> None:
        """One Gibbs sweep, from the longest contexts to their parents."""
        d2, d1 = self.discounts
        if self.how.words > 1:
            one, _ = self.chances(below)
            self.t2 = reseat(self.c2, self._others(self.t2, self.ctx2, self.n2), one[self.pair], d2, self.how, self.rng)
        sent = self._sent()
        self.t1 = np.clip(self.t1, np.minimum(sent, 1), sent)
        self.t1 = reseat(sent, self._others(self.t1, self.ctx1, self.n1), below, d1, self.how, self.rng)

    def averaged(self, below: np.ndarray) -> np.ndarray:
        """The cells' predictive probabilities, averaged over samples after burn-in."""
        out = np.zeros(len(self.c2))
        for i in range(self.how.burn_in + self.how.samples):
            self.sweep(below)
            if i >= self.how.burn_in:
                out += self.chances(below)[1]
        return out / self.how.samples


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return float(np.clip(ones / max(1.0, ones + 2 * twos), 0.1, 0.95))


# --- packing ----------------------------------------------------------------------------------------------------------

_KIND = {"u": "<u4", "v": "<u4", "w": "<u4", "counts": "<u4", "reach": "<u4", "at": "<u4", "times": "<u4", "docs": "<i8", "sizes": "<u4"}
_PACK = ("words", *_KIND)
_POSTS = ("cell", "reach", "at", "times", "docs", "sizes")
_CELLS = {"pair": "<u4", "ctx2": "<u4", "ctx1": "<u4", "word": "<u4", "count": "<u4"}
#: Those that rise within a row and are packed as differences, which wrap (with two words of context `ctx2` rises only in part).
_RISING = {"v", "cell", "pair", "ctx2", "ctx1"}


def _pack(values: np.ndarray, kind: str, rising: bool = False) -> bytes:
    """The bytes of equal weight together; of `rising` values their differences."""
    values = np.ascontiguousarray(values, dtype=kind)
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=3).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _open(blob: bytes, kind: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def _pack_words(words: np.ndarray) -> bytes:
    """Sorted hashes."""
    return _pack(words, "<u8", True)


def _open_words(blob: bytes) -> np.ndarray:
    return _open(blob, "<u8", True)


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two 32-bit keys: the row that stands for each distinct pair, and each row's number among those."""
    key = (keys[0].astype(np.int64) << 32) | keys[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    del key
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return order[new], number


def _slices(buckets: int, context: int):
    """A row per slice of texts and bucket of the word before: the distinct words with their contexts, how often the training rows have them, and where they occur.

    The bucket of END, which every text's first token falls into, also gets the ids and sizes of the slice's texts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, 1, 8 << 20):
                hashes, begins = word_hashes(part.column(1))
                tidy()  # what the hashing took is not kept beside the sorting
                hashes >>= CUT
                tokens = np.insert(hashes, begins[1:], END)
                del hashes
                sizes = np.diff(begins) + 1
                first = np.cumsum(sizes) - sizes
                words, ids = np.unique(tokens, return_inverse=True)
                ids = ids.astype(np.uint32)
                del tokens
                spot = (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(spot, kind="stable")  # words of a bucket stand together
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                end = ids[-1]  # every text ends with it
                before = np.append(end, ids[:-1])
                before[first] = end
                left = rank[before]
                left <<= 32
                left |= ids
                del ids
                right = np.repeat(np.arange(part.num_rows), sizes)
                if context > 1:
                    two = np.append(end, before[:-1])
                    two[first] = end
                    right |= two.astype(np.int64) << 32
                    del two
                del before
                place = np.lexsort((right, left)) if context > 1 else np.argsort(left, kind="stable")  # texts stand in order
                left, right = left[place], right[place]
                del place
                start = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
                times = np.diff(np.append(start, len(left))).astype(np.uint32)
                left, right = left[start], right[start]
                v, w, u, at = (x.astype(np.uint32) for x in (order[left >> 32], left & 0xFFFFFFFF, right >> 32, right & 0xFFFFFFFF))
                cell = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (u[1:] != u[:-1])))
                del left, right, rank, order
                train = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.add.reduceat(times * train[at], cell)
                reach = np.diff(np.append(cell, len(start)))
                home = int(END % np.uint64(buckets))
                edge = np.searchsorted(spot[v[cell]], np.arange(buckets + 1))
                post = np.append(cell, len(start))[edge]
                for b in range(buckets):
                    lo, hi = edge[b], edge[b + 1]
                    if lo == hi:
                        continue
                    mine, own, n = cell[lo:hi], slice(post[b], post[b + 1]), hi - lo
                    local, three = np.unique(np.concatenate([v[mine], w[mine], *([u[mine]] if context > 1 else [])]), return_inverse=True)
                    none = np.zeros(0)
                    docs = part.column(0).to_numpy(zero_copy_only=False) if b == home else none
                    blobs = {"u": three[2 * n :], "v": three[:n], "w": three[n : 2 * n], "counts": counts[lo:hi], "reach": reach[lo:hi], "at": at[own], "times": times[own], "docs": docs, "sizes": sizes if b == home else none}
                    packed = [_pack_words(words[local]), *(_pack(blobs[p], kind, p in _RISING) for p, kind in _KIND.items())]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["bucket", "slice", *_PACK])
                number += 1

    return rows


def _bucket(buckets: int, context: int):
    def bucket(key: tuple, group: pa.Table) -> pa.Table:
        """The rows of a bucket: the places where its cells occur, slice by slice, in rows of about ROW_BYTES; the first (part 0) also has the cells and what the unigram restaurant and the discounts need."""
        parts = group.select(_PACK).to_pylist()
        own = [_open_words(row["words"]) for row in parts]
        words = np.unique(np.concatenate(own))
        ids = [np.searchsorted(words, x).astype(np.uint32) for x in own]
        lengths = [len(_open(row["v"], "<u4")) for row in parts]
        v, w = (np.concatenate([i[_open(row[x], "<u4", x in _RISING)] for i, row in zip(ids, parts, strict=True)]) for x in "vw")
        first, cell = _numbered(v, w)
        pair_v, pair_w = v[first], w[first]
        del v, w
        pair = ctx2 = np.arange(len(first))
        if context > 1:
            u = np.concatenate([i[_open(row["u"], "<u4")] for i, row in zip(ids, parts, strict=True)])
            of_pair = cell
            first, cell = _numbered(of_pair, u)
            pair = of_pair[first]
            _, ctx2 = _numbered(pair_v[pair], u[first])
            del u, of_pair
        del own, ids, first
        count = np.bincount(cell, weights=np.concatenate([_open(row["counts"], "<u4") for row in parts])).astype(np.int64)
        _, ctx1 = np.unique(pair_v, return_inverse=True)
        sent = np.bincount(pair, weights=(count > 0) if context > 1 else count, minlength=len(pair_v))
        raw = np.bincount(pair_w[pair], weights=count, minlength=len(words)).astype(np.int64)
        tables = np.bincount(pair_w, weights=sent > 0, minlength=len(words)).astype(np.int64)
        used = np.unique(pair_w)
        posts = {p: [] for p in _POSTS}
        at = 0
        for n, part in zip(lengths, parts, strict=True):
            for name in _POSTS:  # all but the cells' numbers go on as they came
                posts[name].append(_pack(cell[at : at + n], "<u4", True) if name == "cell" else part[name])
            at += n
        cells = {"pair": pair, "ctx2": ctx2, "ctx1": ctx1, "word": pair_w, "count": count}
        row = {"c_words": _pack_words(words), **{f"c_{k}": _pack(x, _CELLS[k], k in _RISING) for k, x in cells.items()}}
        row |= {"stats": [float(x) for x in ((count == 1).sum(), (count == 2).sum(), (sent == 1).sum(), (sent == 2).sum())], **_dealt(words[used], buckets, raw[used], tables[used])}
        slices = group.column("slice").to_pylist()
        size = np.cumsum([sum(len(posts[p][k]) for p in _POSTS) for k in range(len(slices))])
        cuts = [0, *(np.flatnonzero(np.diff(size // ROW_BYTES)) + 1).tolist(), len(slices)]
        rows = []
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rows.append({"bucket": key[0].as_py(), "part": part, "slices": slices[lo:hi], **{p: posts[p][lo:hi] for p in _POSTS}} | (row if not part else {}))
        return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in _BUCKET_FIELDS})

    return bucket


def _dealt(words: np.ndarray, shards: int, raw: np.ndarray, sent: np.ndarray) -> dict[str, list[bytes]]:
    """A bucket's words, their counts there and the tables they take there, packed for each shard of the unigram restaurant."""
    spot = words % np.uint64(shards)
    own = [np.flatnonzero(spot == s) for s in range(shards)]
    return {"seen": [_pack_words(words[o]) for o in own], "raw": [_pack(raw[o], "<u8") for o in own], "sent": [_pack(sent[o], "<u8") for o in own]}


def _shard(key: tuple, group: pa.Table) -> pa.Table:
    """The unigram restaurant's words of one shard summed over all buckets, and dealt back to each; the first row also has the shard's totals."""
    rows = group.to_pylist()
    words = [_open_words(r["seen"]) for r in rows]
    every = np.unique(np.concatenate(words))
    at = [np.searchsorted(every, w) for w in words]
    known, sent = (np.bincount(np.concatenate(at), weights=np.concatenate([_open(r[c], "<u8") for r in rows]), minlength=len(every)).astype(np.int64) for c in ("raw", "sent"))
    totals = [float(x) for x in (known.sum(), (known > 0).sum(), sent.sum(), (sent > 0).sum(), (sent == 1).sum(), (sent == 2).sum())]
    nothing = [0.0] * len(totals)
    packed = [(r["bucket"], r["seen"], _pack(known[a], "<u8"), _pack(sent[a], "<u8"), nothing if i else totals) for i, (r, a) in enumerate(zip(rows, at, strict=True))]
    return pa.table({n: pa.array(list(v), t) for (n, t), v in zip((("bucket", pa.int32()), ("p_seen", pa.binary()), ("p_known", pa.binary()), ("p_sent", pa.binary()), ("totals", pa.list_(pa.float64()))), zip(*packed, strict=True), strict=True)})


#: Packed bytes of places in a row: rows are copied whole several times on their way.
ROW_BYTES = 8 << 20
_BUCKET_FIELDS = [
    pa.field("bucket", pa.int32()), pa.field("part", pa.int32()), pa.field("slices", pa.list_(pa.int64())), *(pa.field(p, pa.list_(pa.binary())) for p in _POSTS),
    *(pa.field(f"c_{k}", pa.binary()) for k in ("words", *_CELLS)), pa.field("stats", pa.list_(pa.float64())), *(pa.field(n, pa.list_(pa.binary())) for n in ("seen", "raw", "sent")),
]
_BUCKET_ROW = "bucket int, part int, slices array<long>, " + ", ".join(f"{p} array<binary>" for p in _POSTS) + ", " + ", ".join(f"c_{k} binary" for k in ("words", *_CELLS)) + ", stats array<double>, seen array<binary>, raw array<binary>, sent array<binary>"

def _with_unigrams(rows: DataFrame, sent: DataFrame) -> tuple[DataFrame, list[float]]:
    """`rows` of buckets with the counts of their words in the unigram restaurant, and that restaurant's totals.

    `sent` has the packed counts and tables of each bucket, an entry a shard of words. The
    buckets' rows stay where they are: only the unigram's counts move.
    """
    dealt = sent.select("bucket", F.posexplode(F.arrays_zip("seen", "raw", "sent")).alias("shard", "x")).select("bucket", "shard", "x.seen", "x.raw", "x.sent")
    back = written(dealt.groupBy("shard").applyInArrow(_shard, "bucket int, p_seen binary, p_known binary, p_sent binary, totals array<double>"), "unigrams")
    facts = back.agg(*(F.sum(F.get("totals", F.lit(i))) for i in range(6))).first()
    own = back.groupBy("bucket").agg(F.collect_list(F.struct("p_seen", "p_known", "p_sent")).alias("unigrams"))
    own = own.withColumnRenamed("bucket", "of_bucket").hint("merge")
    joined = rows.join(own, (F.col("bucket") == F.col("of_bucket")) & (F.col("part") == 0), "left").drop("of_bucket")
    return joined.sortWithinPartitions("bucket", "part"), [float(x or 0) for x in facts]


def _opened(row: dict, discounts: tuple[float, float], totals: list[float], how: Hierarchy, number: int) -> tuple[Restaurants, dict, np.ndarray, np.ndarray]:
    """A bucket's restaurants, its cells, the unigram probability of each pair's word, and the training count of each pair's word.

    The unigram restaurant's base is continuous, so every known word has one table there,
    and the mass of a new table is that of a word never learned.
    """
    cells = {k: _open(row[f"c_{k}"], kind, k in _RISING).astype(np.int64 if k == "count" else np.int32) for k, kind in _CELLS.items()} | {"words": _open_words(row["c_words"])}
    known, sent = (np.zeros(len(cells["words"]), np.int64) for _ in range(2))
    for part in row["unigrams"]:
        at = np.searchsorted(cells["words"], _open_words(part["p_seen"]))
        known[at], sent[at] = _open(part["p_known"], "<u8"), _open(part["p_sent"], "<u8")
    _, _, customers, tables, ones, twos = totals
    discount = discount_of(ones, twos)
    chance = np.where(sent > 0, sent - discount, how.strength + discount * tables) / (how.strength + customers)
    rng = np.random.default_rng([how.seed, number, row["bucket"]])
    return Restaurants(cells, discounts, how, rng), cells, chance[cells["word"]], known[cells["word"]]


def score_texts(docs: DataFrame, learn: Column, how: Hierarchy = Hierarchy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    Tokens are the words of a text, A-Z lower-cased, and one end. `learn` says which rows
    are learned from. `base_score` is the add-one unigram's log10 probability, `score` that
    of the hierarchical Pitman-Yor model: a token is drawn in the restaurant of the token
    before it (the end mark stands before a text), whose parent is the unigram restaurant
    that all contexts share; with `how.words` = 2 restaurants of two tokens come before,
    whose parents are those of one. The unigram's base is continuous: each known
    word has one table there, and the mass of a new one goes to the single outcome of all
    words never learned (which `base_score` has too). Probabilities over these outcomes sum
    to one in every context. Tables are the customers of the parent.

    Gibbs steps remove all customers of a dish and draw its tables from their conditional
    distribution given the rest (exact to `how.exact` customers, seated in turn beyond).
    Dishes of a restaurant are seated side by side, given each other's tables of the step
    before; the unigram restaurant gets its customers between two rounds of sweeps.
    Predictive probabilities are averaged over the samples after burn-in. Perplexity is
    10 ** (-score / n_tokens).

    Texts are read once. Tokens go by the word before to buckets, so that a context and its
    parent are in one place, packed a row a slice and bucket; the unigram restaurant lies in
    shards of words. Counts are exact and grow with the corpus. Buckets grow in number with
    the input, but the followers of one frequent word are one bucket's work. Words are told
    apart by 48 bits of a hash.

    Null and blank texts are one end token. Each row is scored by itself, also where ids
    repeat or are null. Texts of any length are read whole; ties do not arise; other columns
    are not read. Nothing to learn from: every word is the one new outcome. An empty table
    has an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).cast("int").alias("learn"))
    source = source.select(F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("doc_id"), "text", "learn")
    buckets = width_for(docs, 16 << 20)
    slices = source.mapInArrow(lambda batches: tidied(_slices(buckets, how.words)(batches)), "bucket int, slice long, " + ", ".join(f"{p} binary" for p in _PACK))
    rows = written_in_buckets(slices.groupBy("bucket").applyInArrow(_bucket(buckets, how.words), _BUCKET_ROW), "bucket", 4 * buckets, "cells")  # so that few buckets share a task
    stats = rows.agg(*(F.sum(F.get("stats", F.lit(i))) for i in range(4))).first()
    discounts = (discount_of(stats[0] or 0, stats[1] or 0), discount_of(stats[2] or 0, stats[3] or 0))
    cells = ["bucket", "part", *(f"c_{k}" for k in ("words", *_CELLS))]
    first, totals = _with_unigrams(rows.where("part = 0").select(*cells), rows.where("part = 0").select("bucket", "seen", "raw", "sent"))

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tables that the words of each bucket take in restaurants of one word of context."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                place, own, below, _ = _opened(row, discounts, totals, how, 0)
                for _ in range(how.burn_in):
                    place.sweep(below)
                used = np.unique(own["word"])
                tables = np.bincount(own["word"], weights=place.t1, minlength=len(own["words"])).astype(np.int64)
                raw = np.bincount(own["word"][own["pair"]], weights=own["count"], minlength=len(own["words"])).astype(np.int64)
                dealt = _dealt(own["words"][used], buckets, raw[used], tables[used])
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), *(pa.array([x], pa.list_(pa.binary())) for x in dealt.values())], ["bucket", *dealt])

    again = written(first.mapInArrow(lambda b: tidied(sweeps(b)), "bucket int, seen array<binary>, raw array<binary>, sent array<binary>"), "sent")
    second, totals_again = _with_unigrams(rows.select(*cells, "slices", *_POSTS), again)
    n, v = (int(x) for x in totals_again[:2])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = {c: batch.column(batch.schema.get_field_index(c))[i] for c in (*cells, "unigrams", "slices", *_POSTS)}
                if columns["part"].as_py() == 0:  # the bucket's other rows follow
                    place, own, below, known = _opened({c: columns[c].as_py() for c in (*cells, "unigrams")}, discounts, totals_again, how, 1)
                    known = known[own["pair"]]
                    of_cell = (known > 0, np.log10((known + 1) / (n + v + 1)), np.log10(place.averaged(below)))
                    del place, own, below, known
                posts, slices = {p: columns[p] for p in _POSTS}, columns["slices"].as_py()
                for k, number in enumerate(slices):
                    cell, reach, at, times = (_open(posts[p][k].as_py(), "<u4", p in _RISING) for p in ("cell", "reach", "at", "times"))
                    cell = np.repeat(cell, reach)
                    sums = [np.bincount(at, weights=times * x[cell]) for x in of_cell]
                    blobs = [_pack(x, "<f8") for x in sums] + [posts["docs"][k].as_py(), posts["sizes"][k].as_py()]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], ["slice", *_SUMS, "docs", "sizes"])

    partial = second.mapInArrow(lambda b: tidied(score(b)), "slice long, " + ", ".join(f"{x} binary" for x in (*_SUMS, "docs", "sizes")))
    out = partial.groupBy("slice").applyInArrow(_summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    drop_written(again)
    real_id = F.when(F.col("doc_id") != F.lit(-(2**63) + 1), F.col("doc_id")).alias("doc_id")
    return out.select(real_id, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


_SUMS = ("n_known", "base_score", "score")


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    """The sums of a slice's texts over all buckets."""
    rows = group.to_pylist()
    docs, sizes = next((d, s) for d, s in ((_open(r["docs"], "<i8"), _open(r["sizes"], "<u4")) for r in rows) if len(d))
    sums = {s: np.zeros(len(docs)) for s in _SUMS}
    for row in rows:
        for name, total in sums.items():
            own = _open(row[name], "<f8")
            total[: len(own)] += own
    return pa.table({"doc_id": docs, "n_tokens": sizes.astype(np.int64), "n_known": np.rint(sums["n_known"]).astype(np.int64), "base_score": sums["base_score"], "score": sums["score"]})
