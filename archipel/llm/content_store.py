"""A content-addressed store of token ids: unique chunks, recipes in document order, Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archipel.functions.checksums import joined_crc32
from archipel.llm.common import drop_written, new_path, tidied, width_for, written
from archipel.llm.token_memo import memo, text_slices

#: Chunk boundaries: a rolling hash over WINDOW ids has its low bits clear, at least LEAST and at most MOST ids apart.
WINDOW, MASK, LEAST, MOST = 16, 511, 64, 4096
_FACTOR = 0x9E3779B97F4A7C15


def cut_points(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks begin in a run of documents laid end to end (`begins`: their starts, then the end).

    The rolling hash of the last WINDOW ids comes from doubling: the hash of 2k ids is that
    of the later k plus that of the earlier k times a power of the factor. Cuts depend on
    content alone, so equal passages cut alike wherever they stand.
    """
    if not len(ids):
        return begins[:-1]
    h = ids.astype(np.uint64) * np.uint64(_FACTOR)
    h ^= h >> np.uint64(29)
    span, power = 1, _FACTOR
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span]
        h = h + shifted * np.uint64(power)
        span, power = 2 * span, power * power % (1 << 64)
    wanted = np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + 1
    cuts: list[int] = []
    at = 0
    wanted_list = wanted.tolist()
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        cuts.append(lo)
        while at < len(wanted_list) and wanted_list[at] <= lo:
            at += 1
        while hi - lo > LEAST:
            while at < len(wanted_list) and wanted_list[at] < lo + LEAST:
                at += 1
            new = min(wanted_list[at] if at < len(wanted_list) else hi, lo + MOST)
            if new >= hi:
                break
            cuts.append(new)
            lo = new
    return np.array(cuts, dtype=np.int64)


_STAGED = "kind string, spot int, doc_id long, n int, hashes binary, sizes binary, bytes binary"
_ARROW = pa.schema([("kind", pa.string()), ("spot", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
#: Bytes of a chunk's digest.
DIGEST = 16
#: Bytes of input (as the plan estimates them) for each partition of chunks; a partition's digests take about a tenth of that in memory.
SPOT_BYTES = 64 << 20
#: Digests that a task of the first pass remembers. Forgetting costs shuffling only: the store drops repeats in any case.
REMEMBERED = 200_000


def _stage(tokenizer: str, end_id: int, spots: int):
    """Documents to packs of new chunks (a row a slice and partition) and recipe rows. `spot`: the partition they go to; recipes go by document, so copies part."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack, seen = memo(tokenizer), zstandard.ZstdCompressor(level=1).compress, set()
        for batch in tidied(batches):
            for part in text_slices(batch, 1):
                tokens, begins = encode.encode(part.column(1))
                ids = np.insert(tokens, begins[1:], end_id)
                begins = begins + np.arange(len(begins))
                cuts = cut_points(ids, begins)
                sizes = np.diff(np.append(cuts, len(ids)))
                raw, wide = memoryview(ids.tobytes()), ids.dtype.itemsize
                digests = [hashlib.blake2b(raw[lo * wide : (lo + n) * wide], digest_size=DIGEST).digest() for lo, n in zip(cuts.tolist(), sizes.tolist(), strict=True)]
                packs: dict[int, list[int]] = {}
                for k, digest in enumerate(digests):
                    if digest not in seen:
                        seen.add(digest)
                        packs.setdefault(int.from_bytes(digest[:4], "little") % spots, []).append(k)
                if len(seen) > REMEMBERED:
                    seen.clear()
                rows = [("chunk", spot, None, len(own), b"".join([digests[k] for k in own]), sizes[own].astype("<u4").tobytes(), pack(b"".join([raw[cuts[k] * wide : (cuts[k] + sizes[k]) * wide] for k in own]))) for spot, own in packs.items()]
                first = np.searchsorted(cuts, begins).tolist()
                length = np.diff(begins).tolist()
                for i, doc in enumerate(part.column(0).to_pylist()):
                    hashes = b"".join(digests[first[i] : first[i + 1]])
                    rows.append(("recipe", ((doc or 0) * 0x9E3779B1 + i) % spots, doc, length[i], hashes, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return stage


def _digests(blob: bytes) -> list[bytes]:
    return [blob[i : i + DIGEST] for i in range(0, len(blob), DIGEST)]


def _once(width: int):
    """Packs without the chunks that came before in this partition; recipes pass. Remembers the partition's digests, whose number SPOT_BYTES bounds."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in tidied(batches):
            is_pack = np.array([k == "chunk" for k in batch.column("kind").to_pylist()], dtype=bool)
            yield batch.filter(pa.array(~is_pack))
            for at in np.flatnonzero(is_pack).tolist():
                own = _digests(batch.column("hashes")[at].as_py())
                keep = [k for k, d in enumerate(own) if d not in seen]
                seen.update(own)
                if len(keep) == len(own):
                    yield batch.slice(at, 1)
                elif keep:
                    row = batch.slice(at, 1).to_pylist()[0]
                    sizes, raw = np.frombuffer(row["sizes"], "<u4"), unpack(row["bytes"])
                    ends = np.cumsum(sizes.astype(np.int64)) * width
                    row |= {"n": len(keep), "hashes": b"".join([own[k] for k in keep]), "sizes": sizes[keep].tobytes(), "bytes": pack(b"".join([raw[ends[k] - sizes[k] * width : ends[k]] for k in keep]))}
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return once


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict[str, str]:
    """Writes the ids of `docs` under `path` and returns the places of its three tables.

    chunks    kind 'chunk': n, hashes, sizes, bytes: packs of n chunks, every distinct chunk once, named by digest
              kind 'recipe': the documents' recipes as they came, from which `recipes` is made
    recipes   shard, doc_id, start, n, hashes: in ascending doc_id order; `start` counts the ids before it
    manifest  shard, first_doc, last_doc, n_docs, n_ids, id_bytes, root: the Merkle root over the shard's recipes

    One shuffle carries each task's new chunks, compressed, to the partition of their
    digest. Rows that only point to a chunk are spread, so copies make no hot spot. Null
    texts are empty documents; a long text is one document whatever its length. Null ids
    come first. Repeated ids keep their rows, in the order of their content. An empty table
    makes an empty store.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    spots, id_bytes = width_for(source, SPOT_BYTES), memo(tokenizer).dtype.itemsize
    placed = source.mapInArrow(_stage(tokenizer, end_id, spots), _STAGED).repartition(spots, "spot")
    places = {name: f"{path}/{name}" for name in ("chunks", "recipes", "manifest")}
    # Kinds share a table: a table for each would sort wide rows before they are written.
    placed.mapInArrow(_once(id_bytes), _STAGED).drop("spot").write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(places["chunks"])
    recipes = spark.read.schema("kind string, doc_id long, n int, hashes binary").parquet(places["chunks"]).where("kind = 'recipe'").drop("kind")
    ordered = recipes.repartitionByRange(spots, "doc_id").sortWithinPartitions("doc_id", "hashes").withColumn("shard", F.spark_partition_id())
    ordered = written(ordered, path=f"{path}/ordered")
    totals = _totals(ordered)
    before = totals.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))  # a row for each shard
    running = F.sum("n").over(Window.partitionBy("shard").orderBy("doc_id", "hashes").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ordered.join(F.broadcast(before), "shard").withColumn("start", (F.col("before") + running - F.col("n")).cast("long")).drop("before")
    out.select("shard", "doc_id", "start", "n", "hashes").write.option("compression", "zstd").parquet(places["recipes"])
    _manifest(spark, places).withColumn("id_bytes", F.lit(id_bytes)).write.parquet(places["manifest"])
    drop_written(ordered)
    return places


def _recipes(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    return spark.read.schema("shard int, doc_id long, start long, n int, hashes binary").parquet(places["recipes"])


def _totals(recipes: DataFrame) -> DataFrame:
    return recipes.groupBy("shard").agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _manifest(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """What the manifest must say of the recipes in the files: every column of a recipe is part of its leaf."""
    recipes = _recipes(spark, places)
    facts = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string"), F.col("n").cast("string"), F.hex("hashes"))
    leaves = recipes.select("shard", "start", F.sha2(facts.cast("binary"), 256).alias("leaf"))
    roots = leaves.repartition(width_for(recipes, SPOT_BYTES), "shard").sortWithinPartitions("shard", "start").mapInArrow(_merkle_roots, "shard int, root string")
    return _totals(recipes).join(roots, "shard", "left")


def check_manifest(spark: SparkSession, places: dict[str, str]) -> int:
    """Holds the recipes against the manifest, shard by shard, and returns the bytes of an id. A difference is an error."""
    said = spark.read.schema("shard int, n_ids long, n_docs long, first_doc long, last_doc long, root string, id_bytes int").parquet(places["manifest"])
    facts = ["n_ids", "n_docs", "first_doc", "last_doc", "root"]
    both = said.select("shard", *(F.col(c).alias(f"said_{c}") for c in facts)).join(_manifest(spark, places), "shard", "full")
    wrong = both.where(" or ".join(f"not (said_{c} <=> {c})" for c in facts)).select("shard").take(5)
    if wrong:
        raise ValueError(f"recipes and manifest differ in shards {sorted(r['shard'] for r in wrong)}")
    row = said.select("id_bytes").first()
    return row["id_bytes"] if row else 2


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed together level by level; an odd last one moves up alone. No leaves: the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _merkle_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each shard, from leaves in order of shard and start.

    Keeps at most one pending hash a level, so a shard of any size takes little memory.
    """
    out: dict[int, str] = {}
    pending: list[bytes | None] = []
    current = None

    def close() -> None:
        rest = None
        for own in pending:  # an odd last node joins what is left above it
            rest = own if rest is None else rest if own is None else hashlib.sha256(own + rest).digest()
        out[current] = rest.hex()

    for batch in batches:
        for shard, leaf in zip(batch.column("shard").to_pylist(), batch.column("leaf").to_pylist(), strict=True):
            if shard != current:
                if current is not None:
                    close()
                current, pending = shard, []
            node, level = bytes.fromhex(leaf), 0
            while True:
                if level == len(pending):
                    pending.append(None)
                if pending[level] is None:
                    pending[level] = node
                    break
                node, pending[level] = hashlib.sha256(pending[level] + node).digest(), None
                level += 1
    if current is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.string())], ["shard", "root"])


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[bytes], np.ndarray, memoryview]]:
    """(digests, sizes, the ids as little-endian 32-bit bytes end to end) of every pack; a chunk whose bytes do not match its digest is an error."""
    unpack = zstandard.ZstdDecompressor()
    for batch in tidied(batches):
        for at in range(batch.num_rows):
            hashes, sizes, data = (batch.column(c)[at].as_py() for c in ("hashes", "sizes", "bytes"))
            own, each = _digests(hashes), np.frombuffer(sizes, "<u4").astype(np.int64)
            raw = memoryview(unpack.decompress(data))
            if len(raw) != each.sum() * width or len(own) != len(each):
                raise ValueError(f"the pack of chunk {own[0].hex()} is damaged")
            ends = np.cumsum(each) * width
            for digest, hi, n in zip(own, ends.tolist(), each.tolist(), strict=True):
                if hashlib.blake2b(raw[hi - n * width : hi], digest_size=DIGEST).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
            yield own, each, memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())


def read_chunks(spark: SparkSession, places: dict[str, str], width: int = 2, with_ids: bool = False) -> DataFrame:
    """hash, n and crc (of the ids as little-endian 32-bit) of every stored chunk, and those ids where asked for."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, each, plain in _unpacked(batches, width):
            ends = 4 * np.cumsum(each)
            parts = [plain[hi - 4 * n : hi] for hi, n in zip(ends.tolist(), each.tolist(), strict=True)]
            columns = [pa.array(own, pa.binary()), pa.array(each, pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64())]
            names = ["hash", "size", "crc"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(bytes, parts), pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    stored = spark.read.schema("kind string, n int, hashes binary, sizes binary, bytes binary").parquet(places["chunks"]).where("kind = 'chunk'").drop("kind")
    return stored.mapInArrow(check, "hash binary, size long, crc long" + (", ids binary" if with_ids else ""))


def _rebuilt(spark: SparkSession, places: dict[str, str], chunks: DataFrame, what: str) -> DataFrame:
    """doc_id, start, n_tokens and the document's chunks in order (pos, `what`, n). A chunk that the store lacks, or sizes that do not add up, are errors."""
    split = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("hashes") / DIGEST).cast("int") - 1), lambda i: F.substring(F.col("hashes"), i * DIGEST + 1, F.lit(DIGEST)))
    parts = _recipes(spark, places).select("doc_id", "start", "n", F.posexplode(split).alias("pos", "hash")).join(chunks.select("hash", "size", what), "hash", "left")
    found = F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("a chunk is lost: "), F.hex("hash"))).cast("long")).otherwise(F.col("size"))
    whole = parts.groupBy("doc_id", "start").agg(F.first("n").cast("long").alias("n_tokens"), F.sum(found).alias("held"), F.array_sort(F.collect_list(F.struct("pos", what, F.col("size").alias("n")))).alias("parts"))
    right = F.when(F.col("held") != F.col("n_tokens"), F.raise_error(F.lit("chunks and recipe differ in length")).cast("long")).otherwise(F.col("n_tokens"))
    return whole.select("doc_id", "start", right.alias("n_tokens"), "parts")


def read_documents(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    First the recipes are held against the Merkle manifest. Every chunk is decompressed and
    checked against its digest where it lies; only its CRC-32 moves. A chunk that copies
    share reaches its many recipe rows by a join that adaptive execution can split. A
    document's CRC follows from those of its chunks. A damaged or lost chunk, a changed
    recipe and a changed manifest are errors, never missing rows. Rows of repeated and null
    ids stay apart by their start; an empty store has no rows.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [joined_crc32([p["crc"] for p in parts], [4 * p["n"] for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    width = check_manifest(spark, places)
    chunks = written(read_chunks(spark, places, width), "chunk-crc")
    return _rebuilt(spark, places, chunks, "crc").mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document: the stored streams themselves, checked like those of `read_documents`."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])

    width = check_manifest(spark, places)
    return _rebuilt(spark, places, read_chunks(spark, places, width, True), "ids").mapInArrow(join, "doc_id long, start long, n_tokens long, ids array<long>")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the store of `docs` in the shared folder and returns what `read_documents` finds there."""
    spark = docs.sparkSession
    return read_documents(spark, write_store(docs, new_path(spark, "id-store"), tokenizer, end_id))
