"""Line deduplication: lines that many documents share stay in one of them only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archipel.llm.common import BLANK, drop_written, tidied, written
from archipel.llm.token_memo import text_slices

_OURS = ["n_lines", "n_dropped", "kept_text"]


class Lines:
    """The lines of a slice of texts, and the 128-bit keys of those long enough to count."""

    def __init__(self, texts: pa.Array, min_chars: int):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, "\n")
        self.flat = pc.list_flatten(cut)
        self.begins = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        keys = pc.ascii_trim(pc.list_flatten(pc.split_pattern(pc.ascii_lower(texts), "\n")), BLANK)
        self.at = np.flatnonzero(np.asarray(pc.utf8_length(keys)) >= min_chars)
        digests = b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(self.at)).cast(pa.large_binary()).to_pylist()))
        self.h1, self.h2 = np.frombuffer(digests, "<i8").reshape(-1, 2).T
        self.owner = np.searchsorted(self.begins, self.at, side="right") - 1


class SharedKeys:
    """Keys and their keepers, looked up by binary search."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, keeper: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.keeper = h1[order], h2[order], keeper[order]
        runs = np.diff(np.flatnonzero(np.concatenate([[True], self.h1[1:] != self.h1[:-1], [True]]))) if len(h1) else np.zeros(0, int)
        self.most = int(runs.max(initial=0))  # keys that agree in their first half

    def goes(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the keys are shared and kept in another document than `ids`."""
        out = np.zeros(len(h1), dtype=bool)
        at = np.searchsorted(self.h1, h1)
        for step in range(self.most):
            here = np.minimum(at + step, len(self.h1) - 1)
            out |= (self.h1[here] == h1) & (self.h2[here] == h2) & (self.keeper[here] != ids)
        return out


def _keys(min_chars: int, places: bool):
    """(h1, h2, id) once for each slice of texts; with `places` (id, row, pos, h1, h2) of every line. Rows: id, text, and the text's hash."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for part in text_slices(batch, 1, 8 << 20):
                own = Lines(part.column(1), min_chars)
                ids = part.column(0).to_numpy()[own.owner]
                if places:
                    row = part.column(2).to_numpy()[own.owner]
                    columns = [ids, row, (own.at - own.begins[own.owner]).astype(np.int32), own.h1, own.h2]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "row", "pos", "h1", "h2"])
                else:
                    rows = np.unique(np.column_stack([own.h1, own.h2, ids]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["h1", "h2", "id"])

    return keys


def _rebuilt(part: pa.RecordBatch, flat: pa.Array, begins: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """The slice with n_lines, n_dropped and the texts joined from the lines that stay."""
    dropped = np.append(0, np.cumsum(gone))
    n_lines, n_dropped = np.diff(begins), dropped[begins[1:]] - dropped[begins[:-1]]
    kept = pa.LargeListArray.from_arrays(pa.array(begins - dropped[begins], pa.int64()), flat.filter(pa.array(~gone)))
    text = pc.binary_join(kept, pa.scalar("\n", pa.large_string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), text], [*part.schema.names, *_OURS])


def _in_place(spark: SparkSession, base: DataFrame, common: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Every text meets all shared keys where it lies."""
    own = common.toArrow()
    shared = spark.sparkContext.broadcast(SharedKeys(*(own.column(c).to_numpy() for c in ("h1", "h2", "keeper"))))
    id_at, at = base.columns.index(id_col), base.columns.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for part in text_slices(batch, at, 8 << 20):
                lines = Lines(part.column(at), min_chars)
                ids = part.column(id_at)
                known = np.asarray(ids.is_valid())[lines.owner]
                gone = np.zeros(len(lines.flat), dtype=bool)
                gone[lines.at] = known & shared.value.goes(lines.h1, lines.h2, ids.fill_null(0).to_numpy().astype(np.int64)[lines.owner])
                yield _rebuilt(part, lines.flat, lines.begins, gone)

    return base.mapInArrow(rebuild, _schema(base))


def _by_join(base: DataFrame, source: DataFrame, common: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Positions of the lines that go meet their texts in a hash join: the texts stream past them and are not sorted."""
    lines = source.mapInArrow(_keys(min_chars, True), "id long, row long, pos int, h1 long, h2 long")
    gone = lines.join(common, ["h1", "h2"]).where("id <> keeper").groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone"))
    on = (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__row"))
    joined = base.join(written(gone, "gone").hint("shuffle_hash"), on, "left").drop("__id", "__row")
    names = base.columns
    at = names.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for part in text_slices(batch, at, 8 << 20):
                lines = Lines(part.column(at), 1 << 62)
                places = part.column(part.num_columns - 1)
                owner = np.repeat(lines.begins[:-1], np.asarray(pc.fill_null(pc.list_value_length(places), 0)))
                gone = np.zeros(len(lines.flat), dtype=bool)
                gone[owner + np.asarray(pc.list_flatten(places))] = True
                yield _rebuilt(part.select(names), lines.flat, lines.begins, gone)

    return joined.mapInArrow(rebuild, _schema(base))


def _schema(base: DataFrame) -> T.StructType:
    return T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_keys: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to `docs`.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. A key
    of at least `min_chars` code points that is in at least `min_docs` documents loses all
    its lines but those in the largest id that holds it. Other lines stay, in order.

    Plan: explode the keys' 128-bit hashes, once a slice of texts and document, and count
    distinct documents per hash (partial aggregation, so a key in a third of all documents
    is no hot spot). The keys over the threshold are counted: up to `broadcast_keys` of them
    (24 bytes each) go to every task, and each text is rebuilt where it lies, without a
    shuffle of texts. More are joined to the lines' positions by shuffle; the positions that
    go then meet the texts in a hash join. Both ways give the same rows.

    Null or empty text: one empty line. Rows with a null id hold no key and keep all their
    lines. Repeated rows of one id count as one document. Texts of any length are whole; a
    slice holds one text at least. Other columns pass through; inputs may carry columns
    named as ours, which are then replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.drop(*(c for c in docs.columns if c in _OURS))
    source = base.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    keys = source.select("id", "text").mapInArrow(_keys(min_chars, False), "h1 long, h2 long, id long")
    counted = keys.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    common = written(counted.select("h1", "h2", "keeper"), "shared-lines")
    if common.count() <= broadcast_keys:
        out = _in_place(spark, base, common, min_chars, id_col, text_col)
        drop_written(common)
        return out
    return _by_join(base, source, common, min_chars, id_col, text_col)
