"""Near-duplicate groups by b-bit MinHash with banding, exact confirmation and components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.llm.common import drop_written, pick, tidied, written
from archipel.llm.graph import components
from archipel.llm.token_memo import text_slices

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sketching:
    """How sets are sketched. With 32 bands of 5 rows a pair of similarity 0.8 is missed with probability 3e-6, one of 0.85 with 1e-8."""

    width: int = 5
    threshold: int = 80  # percent
    bands: int = 32
    rows: int = 5
    bits: int = 4
    margin: float = 0.14  # over four standard errors of the estimate: what lies further below the threshold is not confirmed
    rounds: tuple[int, ...] = (3, 10, 32)  # the bands used up to the end of each round of stars

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20_240_229)
        a = rng.integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, rng.integers(0, 1 << 63, self.size, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, A-Z lower-cased, end to end, and where each text begins (and the end)."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    cut = pc.ascii_split_whitespace(plain)
    coded = pc.list_flatten(cut).dictionary_encode()
    of = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)], dtype=np.uint64)
    index = np.asarray(coded.indices)
    begins = np.asarray(cut.offsets) - cut.offsets[0].as_py()
    real = np.asarray(pc.binary_length(coded.dictionary), dtype=np.int64)[index] > 0 if len(index) else np.zeros(0, bool)
    kept = np.append(0, np.cumsum(real))
    return of[index][real] if len(index) else np.zeros(0, np.uint64), kept[begins]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `width` words; a shorter text is one run, a blank one has none."""
    hashes, begins = word_hashes(texts)
    runs = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        runs = mixed(runs + hashes[k : k + len(runs)])
    out = []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if hi - lo >= width:
            own = np.sort(runs[lo : hi - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            short = np.zeros(min(1, hi - lo), dtype=np.uint64)
            for h in hashes[lo:hi]:
                short = mixed(short + h)
            out.append(short)
    return out


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least value of each hash function over a set, as 32 bits."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(values), step):
        np.minimum(least, (values[lo : lo + step, None] * a + b).min(axis=0), out=least)
    return least >> np.uint64(32)


def packed(least: np.ndarray, bits: int) -> bytes:
    """The low bits of all minima, one plane of bits after another."""
    return b"".join(np.packbits((least >> np.uint64(k)).astype(np.uint8) & 1).tobytes() for k in range(bits))


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mixed(keys + column)
    return keys.view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray, how: Sketching) -> np.ndarray:
    """The collision-corrected similarity of packed signatures (arrays of bytes, planes first in the last axis)."""
    plane = -(-how.size // 8)
    differ = np.zeros(np.broadcast_shapes(left.shape, right.shape)[:-1] + (plane,), dtype=np.uint8)
    for k in range(how.bits):
        differ |= left[..., k * plane : (k + 1) * plane] ^ right[..., k * plane : (k + 1) * plane]
    equal = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / how.size
    chance = 2.0**-how.bits
    return (equal - chance) / (1 - chance)


def _sketches(how: Sketching):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = how.coefficients()
        for batch in tidied(batches):
            for part in text_slices(batch, 1):
                rows = []
                for doc, own in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), how.width), strict=True):
                    if len(own):
                        least = minima(own, a, b)
                        mark, keys = xxhash.xxh3_128_digest(own.tobytes()), band_keys(least, how.bands, how.rows)
                        rows.append((doc, len(own), mark, packed(least, how.bits) + keys.astype("<u4").tobytes(), keys))
                    else:
                        rows.append((doc, 0, None, None, None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "mark", "signature", "keys"])

    return sketch


def _sets(width: int, as_bytes: bool):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for part in text_slices(batch, 1):
                raw = [s.tobytes() for s in shingle_sets(part.column(1), width)]
                items = pa.array(raw, pa.binary()) if as_bytes else pa.array([np.frombuffer(x, np.int64) for x in raw], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary()), items], ["id", "mark", "items"])

    return sets


def _sets_of(ids: DataFrame, docs: DataFrame, width: int, as_bytes: bool) -> DataFrame:
    """(id, items) of the documents in `ids`, read again from their texts; of an id's several texts the one with the least mark."""
    rows = pick(docs, "doc_id", ids, "left_semi").select("doc_id", "text").mapInArrow(_sets(width, as_bytes), f"id long, mark binary, items {'binary' if as_bytes else 'array<long>'}")
    return rows.groupBy("id").agg(F.min(F.struct("mark", "items")).alias("least")).select("id", "least.items")


def _likely(how: Sketching):
    """Keeps the pairs whose estimate leaves the threshold possible."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("left", "right"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(left, right, how) >= how.threshold / 100 - how.margin))

    return likely


def linked(own: np.ndarray, others: list[np.ndarray], threshold: int) -> np.ndarray:
    """Whether each of `others` reaches the similarity (percent) with `own`; all are sorted and without repeats."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * shared >= threshold * (len(own) + sizes - shared)


def _block_links(how: Sketching, step: int = 32):
    """Of a block of a bucket's rows: links that join all nodes of different labels that reach the threshold.

    Signatures leave out what lies far below it; full sets decide the rest, likeliest
    first. A link makes its two labels one, and nodes of one label are not compared, so a
    block gives fewer links than it has labels, however many pairs are alike.
    """
    coarse, wanted = -(-how.size // 8) * how.bits, how.threshold / 100

    def block_links(key: tuple, group: pa.Table) -> pa.Table:
        ids, labels, sides = (group.column(c).to_numpy() for c in ("id", "label", "side"))
        both = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        signatures, keys = both[:, :coarse], np.ascontiguousarray(both[:, coarse:]).view("<u4")
        sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        label = np.unique(labels, return_inverse=True)[1]
        here = np.uint32(key[0].as_py() & 0xFFFFFFFF)
        before = np.argmax(keys == here, axis=1)[0] if len(ids) else 0  # earlier bands have their own buckets
        left, right = np.flatnonzero(sides != 2), np.flatnonzero(sides != 1)
        out = []
        for i in left.tolist():
            near = right[label[right] != label[i]]
            near = near[(sides[near] == 2) | (ids[near] > ids[i])]
            near = near[100 * np.minimum(sizes[near], sizes[i]) >= how.threshold * np.maximum(sizes[near], sizes[i])]
            near = near[~(keys[near, :before] == keys[i, :before]).any(axis=1)]  # a pair is looked at in its first bucket
            if not len(near):
                continue
            likely = estimate(signatures[i], signatures[near], how)
            order = np.argsort(-likely, kind="stable")
            near = near[order][likely[order] >= wanted - how.margin]
            while len(near):
                some, near = near[:step], near[step:]
                for j in some[linked(sets[i], [sets[j] for j in some.tolist()], how.threshold)].tolist():
                    if label[j] != label[i]:
                        out.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
        a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return block_links


def _confirmed(pairs: DataFrame, docs: DataFrame, how: Sketching) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as a table. Only texts of paired documents are read into sets."""
    pairs = written(pairs, "pairs")
    wanted = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = written(_sets_of(wanted, docs, how.width, False), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    tested = both.select("a", "b", shared.alias("c"), F.size("x").alias("n"), F.size("y").alias("m"))
    out = written(tested.where(100 * F.col("c") >= how.threshold * (F.col("n") + F.col("m") - F.col("c"))).select("a", "b"), "links")
    drop_written(sets, pairs, wanted)
    return out


def near_duplicates(docs: DataFrame, how: Sketching = Sketching(), block: int = 1024, block_items: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    Two documents are linked if their sets of `how.width`-word shingles have a Jaccard
    similarity of `how.threshold` percent or more; a component is named by its least id,
    which is the document kept.

    1. One pass makes each document's set size, a 128-bit mark of the set, the packed low
       bits of its minima, and its band keys. Documents with equal sets become one node.
    2. In each band bucket every node is paired with the bucket's least node only; the bit
       counts of the signatures drop pairs that are far off; full sets confirm the rest,
       and links join nodes to components (labels). Bands are used in rounds, and each
       round leaves out pairs that earlier ones have joined.
    3. In buckets that still hold several labels, the nodes outside the main one are
       compared with the rest in blocks of at most `block` nodes and about `block_items`
       set members a side: by signature first, then by full sets, label by label.

    So every pair that shares a bucket is either linked through others already or
    compared; a large group of copies costs a row a copy, and neither pairs within a group
    nor all links between two labels are ever listed. Blank and null texts have no shingles
    and no links. A text of any length is one set. Rows of one id are one node; where their
    texts differ, equal sets still join, and the text with the least mark stands for the id
    in other comparisons. A null id is a row of its own: component null, kept true. Other
    columns are not read, whatever their names; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = written(source.mapInArrow(_sketches(how), "doc_id long, n long, mark binary, signature binary, keys array<long>"), "sketch")
    real = sketch.where("doc_id is not null and n > 0")
    marks = written(real.groupBy("mark").agg(F.min("doc_id").alias("rep")), "marks")
    node_of = real.select("doc_id", "mark").join(marks, "mark").select("doc_id", "rep")
    same_set = node_of.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    chosen = marks.groupBy("rep").agg(F.min("mark").alias("rep_mark"))
    nodes = real.join(chosen, (F.col("doc_id") == F.col("rep")) & (F.col("mark") == F.col("rep_mark")), "left_semi").dropDuplicates(["doc_id"])
    nodes = written(nodes.select(F.col("doc_id").alias("id"), "n", "signature", "keys"), "nodes")
    entries = written(nodes.select("id", F.posexplode("keys").alias("band", "key")), "bands")
    buckets = written(entries.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z"), "buckets")
    met = written(entries.join(buckets, "key"), "met")
    drop_written(entries, buckets)
    signature = nodes.select("id", F.substring("signature", 1, -(-how.size // 8) * how.bits).alias("signature"))

    def with_estimate(pairs: DataFrame) -> DataFrame:
        left = pairs.join(signature.select(F.col("id").alias("a"), F.col("signature").alias("left")), "a")
        both = left.join(signature.select(F.col("id").alias("b"), F.col("signature").alias("right")), "b")
        return both.select("a", "b", "left", "right").mapInArrow(_likely(how), "a long, b long")

    labels, since = written(components(same_set.limit(0)), "labels"), 0
    for until in [*(r for r in how.rounds if r < how.bands), how.bands]:
        stars = met.where((F.col("band") >= since) & (F.col("band") < until) & (F.col("id") != F.col("a"))).select("a", F.col("id").alias("b")).distinct()
        mine = stars.join(labels.select(F.col("id").alias("b"), F.col("component").alias("of_b")), "b", "left").join(labels.select(F.col("id").alias("a"), F.col("component").alias("of_a")), "a", "left")
        links = _confirmed(with_estimate(mine.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")), source, how)
        labels, old = written(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)), "labels"), labels
        drop_written(links, old)
        since = until
    label = F.coalesce(F.col("component"), F.col("id")).alias("label")
    held = written(met.join(labels, "id", "left").select("key", "id", label), "held")
    drop_written(met)
    # The component of a bucket's least node is its main side: those nodes need no comparing among themselves.
    open_keys = held.groupBy("key").agg(F.min_by("label", "id").alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "main")
    crowd = held.join(written(open_keys, "open"), "key").select("key", "id", (F.col("label") == F.col("main")).alias("main"), "label")
    crowd = written(crowd.join(nodes.select("id", "n"), "id"), "crowd")
    drop_written(held)
    share = lambda side: F.ceil(F.greatest(F.lit(1.0), F.sum(side.cast("int")) / block, F.sum(F.when(side, F.col("n"))) / block_items)).cast("int")
    blocks = written(crowd.groupBy("key").agg(share(F.col("main")).alias("m"), share(~F.col("main")).alias("k")), "blocks")
    dealt = crowd.join(blocks, "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A block of the main side meets every block of the others; each two blocks of the others meet.
    mains = dealt.where("main").select("key", "id", "label", F.lit(2).alias("side"), every("k").alias("p"), (-1 - own("m")).alias("q"))
    asks = dealt.where("not main").select("key", "id", "label", F.lit(1).alias("side"), own("k").alias("p"), every("m").alias("q")).withColumn("q", -1 - F.col("q"))
    rest = dealt.where("not main").select("key", "id", "label", own("k").alias("s"), every("k").alias("o"))
    rest = rest.select("key", "id", "label", F.when(F.col("s") == F.col("o"), 0).when(F.col("s") < F.col("o"), 1).otherwise(2).alias("side"), F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"))
    wanted = written(crowd.select("id").distinct(), "ids")
    signed = nodes.join(wanted, "id", "left_semi").select("id", "signature")
    whole = written(signed.join(_sets_of(wanted, source, how.width, True), "id"), "sets")
    full = mains.unionByName(asks).unionByName(rest).join(whole, "id")
    more_links = written(full.groupBy("key", "p", "q").applyInArrow(_block_links(how), "a long, b long").distinct(), "block-links")
    drop_written(whole, crowd, blocks, wanted)
    final = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more_links).unionByName(same_set))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "__id"), F.col("doc_id") == F.col("__id"), "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
