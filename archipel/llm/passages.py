"""Passages that repeat across documents: prefix filtering of anchored paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.llm.common import drop_written, pick, shuffle_width, written
from archipel.llm.graph import components
from archipel.llm.minhash import mixed, word_hashes
from archipel.llm.token_memo import text_slices


@dataclass(frozen=True)
class Paragraphs:
    """Any run of `length` + `gap` - 1 = 51 words that two documents share holds a paragraph that both cut alike."""

    length: int = 32
    gap: int = 20
    width: int = 5
    threshold: int = 80  # percent

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Sets of similarity `threshold` share one of so many least members: of n, all but `threshold` percent are needed, and one more."""
        return n + (-n * self.threshold) // 100 + 1

    @property
    def members(self) -> int:
        """The most members that a set has."""
        return self.length - self.width + 1

    def apart(self, both: np.ndarray) -> np.ndarray:
        """The most members that only one of two similar sets has, which have `both` members counted apart."""
        return (np.arange(2 * self.members + 1) * (100 - self.threshold) // (100 + self.threshold))[both]


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each place on."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : k + len(out)])
    return out


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of `span` values from each place on, by doubling."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(order: np.ndarray, begin: int, end: int, how: Paragraphs) -> np.ndarray:
    """Where paragraphs of the document at begin..end start: the least `order` of every `gap` neighbouring places (winnowing).

    Documents shorter than a paragraph have none; shorter than a paragraph and a gap, one.
    """
    places = order[begin : max(begin, end - how.length + 1)]
    if not len(places):
        return np.zeros(0, np.int64)
    if len(places) <= how.gap:
        return np.array([begin + int(places.argmin())])
    least = _sliding_min(places, how.gap)
    # A place is chosen if some window around it has its value as minimum: the largest of these minima is its own.
    padded = np.concatenate([np.zeros(how.gap - 1, np.uint64), least, np.zeros(how.gap - 1, np.uint64)])
    reach = (~_sliding_min(~padded, how.gap))[: len(places)]
    return begin + np.flatnonzero(places == reach)


def _cut(texts: pa.Array, how: Paragraphs) -> tuple[np.ndarray, ...]:
    """The paragraphs of the texts: text, place among its words, name (hash and parities) and other parities of each; its shingles' hashes in order, and which are the first of their value."""
    hashes, begins = word_hashes(texts)
    # Anchors depend on three words only, so passages anchor alike up to their edges.
    order = _runs(hashes, 3)
    order = np.append(order, np.full(len(hashes) - len(order), np.iinfo(np.uint64).max, dtype=np.uint64))
    found = [anchors(order, lo, hi, how) for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    at = np.concatenate([*found, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    whole = np.zeros(len(at), dtype=np.uint64)
    for k in range(how.length):
        whole = mixed(whole + hashes[at + k])
    shingles = _runs(hashes, how.width)
    items = np.lib.stride_tricks.sliding_window_view(shingles, how.members)[at] if len(at) else np.zeros((0, how.members), np.uint64)
    items, first = _distinct(items)
    marks = _parity(items, first, 64)
    whole = whole >> np.uint64(32) << np.uint64(32) | marks >> np.uint64(32)
    return owner, at - begins[:-1][owner], whole, marks & np.uint64(0xFFFFFFFF), items, first


def _distinct(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of each row in order, and which are the first of their value."""
    items = np.sort(items, axis=1)
    return items, np.column_stack([np.ones(len(items), bool), items[:, 1:] != items[:, :-1]])


def _parity(items: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """`bits` parities of each set's members: two sets differ in no more bits than members."""
    one = np.left_shift(np.uint64(1), items % np.uint64(bits))
    return np.bitwise_xor.reduce(np.where(first, one, np.uint64(0)), axis=1)


def _paragraph_rows(how: Paragraphs):
    """Entries (key, whole, doc, pos): a key is one of a paragraph's least shingles in its upper half, and 32 parities of the shingles in its lower.

    `whole` names the paragraph: a hash of its words in the upper half, 32 further parities in the lower.
    The entries of the least shingle have the place and list every paragraph; in the others
    it is -1, and of a paragraph that repeats within a slice they have the least and the
    greatest document. `pos` is the place times (how.members + 1), plus how many members the set has.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, 4 << 20):
                docs = part.column(0).to_numpy(zero_copy_only=False)
                owner, pos, whole, low, items, first = _cut(part.column(1), how)
                doc = docs[owner]
                order = np.lexsort((pos, doc, whole))
                doc, pos, whole = doc[order], pos[order], whole[order]
                same = np.append(False, whole[1:] == whole[:-1])
                last = np.append(~same[1:], True)[: len(same)]
                heads = np.flatnonzero(~same[: len(whole)])
                least = doc[heads[np.cumsum(~same[: len(whole)]) - 1]] if len(whole) else doc
                ends = ~same[: len(whole)] | (last & (doc != least))
                for lo in range(0, len(order), 16384):
                    here = slice(lo, lo + 16384)
                    own, new, mark = items[order[here]], first[order[here]], low[order[here]]
                    rank, n = np.cumsum(new, axis=1) - 1, new.sum(axis=1)
                    used = new & (rank < how.prefix(n)[:, None])
                    used &= (rank == 0) | ends[here][:, None]
                    row, col = np.nonzero(used)
                    key = (mixed(own[row, col]) >> np.uint64(32) << np.uint64(32)) | mark[row]
                    places = np.where(col == 0, pos[here][row], -1) * (how.members + 1) + n[row]
                    columns = [key.view(np.int64), whole[here][row].view(np.int64), doc[here][row].astype(np.int64), places.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "whole", "doc", "pos"])

    return rows


def _in_groups(group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All pairs i < j of rows of one group (groups lie together); groups of more than `most` rows are given as ranges instead."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    large = sizes > most
    ahead = np.repeat(np.where(large, 0, starts + sizes), sizes) - np.arange(len(group)) - 1
    ahead = np.maximum(0, ahead)
    left = np.repeat(np.arange(len(group)), ahead)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    return left, right, list(zip(starts[large].tolist(), (starts + sizes)[large].tolist(), strict=True))


def _apart(lo: np.ndarray, hi: np.ndarray, i, j) -> np.ndarray:
    """Whether two paragraphs are found in different documents: not both in one and the same only."""
    return np.minimum(lo[i], lo[j]) < np.maximum(hi[i], hi[j])


def _may_be_similar(marks: np.ndarray, n: np.ndarray, i, j, how: Paragraphs) -> np.ndarray:
    """Whether sets with these parities and numbers of members may be similar: no similar ones differ in more parities than members."""
    return np.bitwise_count(marks[i] ^ marks[j]) <= how.apart(n[i] + n[j])


def _forest(lo: int, hi: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the rows lo..hi: each row is tested against all later ones that are not yet in its tree. near(i, rows) gives those linked to i."""
    labels, out = np.arange(lo, hi), []
    for i in range(lo, hi - 1):
        open_rows = i + 1 + np.flatnonzero(labels[i + 1 - lo :] != labels[i - lo])
        if len(open_rows):
            linked = near(i, open_rows)
            if len(linked):
                trees, at = np.unique(labels[linked - lo], return_index=True)
                out += [(i, j) for j in linked[at].tolist()]
                labels[np.isin(labels, trees)] = labels[i - lo]
    return out


def _all_linked(lo: int, hi: int, near, most: int) -> np.ndarray | None:
    """All linked pairs of the rows lo..hi; None as soon as they are more than `most` a row. near(i, rows) gives those linked to i."""
    out, n = [np.zeros((0, 2), np.int64)], 0
    for i in range(lo, hi - 1):
        linked = near(i, np.arange(i + 1, hi))
        n += len(linked)
        if n > most * (hi - lo):
            return None
        if len(linked):
            out.append(np.column_stack([np.full(len(linked), i), linked]))
    return np.concatenate(out)


def _whole_groups(batches: Iterator[pa.RecordBatch], of, least: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches sorted by a group, cut anew so that none is divided; of(batch) gives the group of each row."""
    held, n, tail = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = of(batch)
        starts = np.flatnonzero(np.append(tail is None or group[0] != tail, group[1:] != group[:-1]))
        if n + batch.num_rows >= least and len(starts) and (starts[-1] or held):
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
            held, n = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
        tail = group[-1]
    if held:
        yield pa.Table.from_batches(held)


def _meetings(how: Paragraphs, most: int = 64):
    """Of entries sorted by key, whole, doc, pos: members of equal paragraphs, and possible links between unequal ones that share a key.

    All distinct paragraphs of a key are compared by their parities, which drop no pair of
    the wanted similarity. Where more than `most` paragraphs meet and have more than half as
    many possible links each, only a spanning forest of these is given, marked `crowded`.
    """

    def bucket(batch) -> np.ndarray:
        return batch.column(0).to_numpy() >> 32

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, bucket):
            key, whole, doc, pos = (table.column(c).to_numpy() for c in range(4))
            pos, size = np.divmod(pos, how.members + 1)
            new = np.append(True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1]))
            node = np.cumsum(new) - 1
            listed = np.flatnonzero(pos >= 0)
            member = listed[np.bincount(node[listed], minlength=node[-1] + 1)[node[listed]] > 1]
            heads = np.flatnonzero(new)
            name, n, low, high = whole[heads], size[heads], doc[heads], doc[np.append(heads[1:], len(key)) - 1]
            marks = (key[heads] & 0xFFFFFFFF).astype(np.uint64) << np.uint64(32) | (name & 0xFFFFFFFF).astype(np.uint64)
            i, j, crowds = _in_groups(key[heads] >> 32, most)
            kept = _may_be_similar(marks, n, i, j, how) & (name[i] != name[j]) & _apart(low, high, i, j)
            links, forests = [np.column_stack([i[kept], j[kept]])], [np.zeros((0, 2), np.int64)]

            def near(i: int, rows: np.ndarray) -> np.ndarray:
                return rows[_may_be_similar(marks, n, i, rows, how) & (name[i] != name[rows]) & _apart(low, high, i, rows)]

            for begin, end in crowds:
                pairs = _all_linked(begin, end, near, most // 2)
                if pairs is None:
                    forests.append(np.array(_forest(begin, end, near), dtype=np.int64).reshape(-1, 2))
                else:
                    links.append(pairs)
            a, b = np.concatenate([*links, *forests]).T
            crowded = np.arange(len(a)) >= sum(map(len, links))
            none = pa.nulls(len(member), pa.int64())
            columns = [pa.chunked_array([pa.array(whole[member]), pa.array(name[a])]), pa.chunked_array([pa.array(doc[member]), pa.array(low[a])]), pa.chunked_array([pa.array(pos[member]), pa.nulls(len(a), pa.int64())])]
            columns += [pa.chunked_array([none, pa.array(c)]) for c in (high[a], name[b], low[b], high[b])]
            columns.append(pa.chunked_array([pa.nulls(len(member), pa.bool_()), pa.array(crowded)]))
            yield from pa.table(columns, ["whole", "doc", "pos", "high", "whole2", "doc2", "high2", "crowded"]).combine_chunks().to_batches()

    return meetings


def _contents(how: Paragraphs):
    """The shingle hashes of asked-for paragraphs of each document."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, 4 << 20):
                owner, pos, whole, _, items, _ = _cut(part.column(1), how)
                asked = part.column(2)
                wanted = set(zip(np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(asked))).tolist(), pc.list_flatten(asked).to_pylist(), strict=True))
                kept = np.array([(o, w) in wanted for o, w in zip(owner.tolist(), whole.view(np.int64).tolist(), strict=True)], dtype=bool)
                flat = np.ascontiguousarray(items[kept])
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                docs = part.column(0).to_numpy(zero_copy_only=False)[owner[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(whole[kept].view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(pos[kept].astype(np.int64)), packed], ["whole", "doc", "pos", "items"])

    return contents


def _similar(items: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, how: Paragraphs, step: int = 16384) -> np.ndarray:
    """Whether the sets of rows i and j have the wanted Jaccard similarity."""
    out = [np.zeros(0, bool)]
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        both, distinct = _distinct(np.concatenate([items[a], items[b]], axis=1))
        union = distinct.sum(axis=1)
        out.append(100 * (first[a].sum(axis=1) + first[b].sum(axis=1) - union) >= how.threshold * union)
    return np.concatenate(out)


def _proved(how: Paragraphs):
    """Of pairs (a, b) with the shingles of both, those of the wanted similarity."""

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, -1) for c in (2, 3)]
                items, first = _distinct(np.concatenate(both))
                real = pa.array(_similar(items, first, np.arange(n), np.arange(n, 2 * n), how))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(real) for c in (0, 1)], ["a", "b"])

    return proved


def _distinct_pairs(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of rows below n, in order: as single numbers, which sort far faster than rows of two."""
    return np.divmod(np.unique(i * n + j), max(1, n))


def _links(how: Paragraphs, most: int = 64):
    """Of paragraphs sorted by crowd, with shingles: links that join all similar ones."""

    def crowd_of(batch) -> np.ndarray:
        return batch.column(0).to_numpy()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, crowd_of, 1 << 14):
            crowd, whole, low, high = (table.column(c).to_numpy() for c in range(4))
            items = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(len(crowd), -1)
            items, first = _distinct(items)
            marks, n = _parity(items, first, 64), first.sum(axis=1)
            # Within a crowd too, similar sets share one of their least members.
            rank = np.cumsum(first, axis=1) - 1
            row, col = np.nonzero(first & (rank < how.prefix(n)[:, None]))
            member = items[row, col]
            order = np.lexsort((row, member, crowd[row]))
            row, member = row[order], member[order]
            new = np.append(True, (member[1:] != member[:-1]) | (crowd[row[1:]] != crowd[row[:-1]]))
            i, j, crowds = _in_groups(np.cumsum(new), most)
            i, j = row[i], row[j]
            kept = _may_be_similar(marks, n, i, j, how) & _apart(low, high, i, j)
            i, j = _distinct_pairs(i[kept], j[kept], len(crowd))
            real = _similar(items, first, i, j, how)
            found = [np.column_stack([i[real], j[real]])]

            for begin, end in crowds:
                own = row[begin:end]

                def near(i: int, rows: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                    mine, others = own[i], own[rows]
                    kept = _may_be_similar(marks, n, mine, others, how) & _apart(low, high, mine, others)
                    rows, others = rows[kept], others[kept]
                    return rows[_similar(items, first, np.full(len(rows), mine), others, how)]

                forest = np.array(_forest(0, len(own), near), dtype=np.int64).reshape(-1, 2)
                found.append(own[forest])
            a, b = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays([pa.array(whole[a]), pa.array(whole[b])], ["a", "b"])

    return links


def repeated_passages(docs: DataFrame, how: Paragraphs = Paragraphs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, cluster_id, kept) of every passage that other documents share.

    Text runs on across lines, so paragraphs are not lines here: a paragraph is `how.length`
    words from a content-defined anchor, and any shared run of 51 words holds one. Equal
    paragraphs are members of the same cluster without further proof (32 bits of hash and
    64 parities agree). Unequal ones are found by prefix filtering, which misses none:
    sets of five-word shingles whose exact Jaccard similarity reaches `how.threshold`
    share one of their least members. All paragraphs with such a member in common are
    compared by parities and size, which only drop pairs below the threshold; what is left is compared
    by full sets, pair by pair. Where a member's paragraphs are many and nearly all alike,
    they join to crowds instead, and within a crowd all that are not yet linked are compared.
    Paragraphs that are both in one and the same document only are not compared.
    Clusters are the components of confirmed links. Overlapping paragraphs of a document
    join to passages; `start` and `n_words` count words. In each cluster the least document
    keeps its passage (`kept`), the others' are for removal. `cluster_id` is the least
    cluster of the passage. Repeats inside one document alone are not reported.

    Equal paragraphs of one slice of texts shrink to one entry before the shuffle, so a
    passage in a third of all documents sends a row a slice. Null ids and null, blank and
    short texts have no passages; rows of one id count as one document.
    """
    spark = docs.sparkSession
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(_paragraph_rows(how), "key long, whole long, doc long, pos long")
    width = max(8, shuffle_width(spark))
    met = rows.repartition(width, F.shiftright("key", 32)).sortWithinPartitions("key", "whole", "doc", "pos").mapInArrow(_meetings(how), "whole long, doc long, pos long, high long, whole2 long, doc2 long, high2 long, crowded boolean")
    met = written(met, "met")
    possible = met.where("whole2 is not null")
    ends = possible.select("whole", "doc", "high").unionByName(possible.select(F.col("whole2").alias("whole"), F.col("doc2").alias("doc"), F.col("high2").alias("high")))
    nodes = written(ends.groupBy("whole").agg(F.min("doc").alias("low"), F.max("high").alias("high")), "near-nodes")
    crowds = written(components(possible.where("crowded").select(F.col("whole").alias("a"), F.col("whole2").alias("b"))), "crowds")
    wanted = written(nodes.groupBy(F.col("low").alias("doc")).agg(F.collect_list("whole").alias("wholes")), "wanted")
    asked = pick(source, "doc", written(wanted.select("doc"), "ids"), "left_semi").join(wanted, "doc")
    items = written(asked.select("doc", "text", "wholes").mapInArrow(_contents(how), "whole long, doc long, pos long, items binary"), "paragraph-items")
    sets = items.select("whole", "items").dropDuplicates(["whole"])
    pairs = possible.where("not crowded").select(F.least("whole", "whole2").alias("a"), F.greatest("whole", "whole2").alias("b")).distinct()
    side = [sets.select(F.col("whole").alias(c), F.col("items").alias(f"items_{c}")) for c in ("a", "b")]
    proved = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "items_a", "items_b").mapInArrow(_proved(how), "a long, b long")
    crowd = pick(sets, "whole", crowds, "inner").join(nodes, "whole").select("component", "whole", "low", "high", "items")
    joined = crowd.repartition(width, "component").sortWithinPartitions("component", "whole").mapInArrow(_links(how), "a long, b long")
    linked = written(proved.unionByName(joined), "paragraph-links")
    of_whole = written(components(linked), "clusters")
    near = items.select("whole", "doc", "pos").join(of_whole.select(F.col("id").alias("whole")), "whole", "left_semi")
    members = met.where("whole2 is null").select("whole", "doc", "pos").unionByName(near).distinct()
    members = written(members.join(of_whole, F.col("whole") == F.col("id"), "left").select("doc", "pos", F.coalesce("component", "whole").alias("cluster")), "members")
    keepers = written(members.groupBy("cluster").agg(F.min("doc").alias("keeper"), F.max("doc").alias("other")).where("keeper < other").drop("other"), "keepers")
    marked = members.join(keepers, "cluster").withColumn("kept", F.col("doc") == F.col("keeper"))
    in_order = Window.partitionBy("doc", "kept").orderBy("pos")
    fresh = F.coalesce((F.col("pos") > F.lag("pos").over(in_order) + how.length).cast("int"), F.lit(1))
    islands = marked.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("doc", "kept", "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + how.length).alias("n_words"), F.min("cluster").alias("cluster_id"))
    drop_written(nodes, crowds, items)
    return out.select(F.col("doc").alias("doc_id"), "start", "n_words", "cluster_id", "kept")
