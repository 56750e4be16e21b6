"""Packing, counting and storing of token ids against the tokenizer library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from archipel.functions.checksums import joined_crc32
from archipel.llm.content_store import cut_points, merkle_root, store_and_read, write_store
from archipel.llm.packing import complete_bins, pack_documents
from archipel.llm.token_counts import count_tokens, counter
from archipel.llm.token_memo import memo

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
BITS = ["a", "b", "'", "s", ",", ".", "!", " ", "\n", "é", "é", "Σ", "1", " ", "<|endoftext|>", "的", "ß", "İ", "|", "the", "\x1d", "\x0b", "\x02"]
SCHEMA = "doc_id long, text string, lang string, n int, start string"


def rows():
    random.seed(3)
    texts = ["", None, "a", "word " * 5000, "x" * 9000, "same text", "same text", *("".join(random.choice(BITS) for _ in range(random.randint(0, 60))) for _ in range(60))]
    return [(i, t, None, None, "clash") for i, t in enumerate(texts)] + [(3, "word " * 5000, "en", 1, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def true_ids(text):
    return Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_random_texts_have_the_librarys_ids_and_counts():
    random.seed(1)
    texts = ["".join(random.choice(BITS) for _ in range(random.randint(0, 25))) for _ in range(3000)]
    ids, begins = memo(BYTE).encode(pa.array(texts))
    want = memo(BYTE).tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(ids[begins[i] : begins[i + 1]].tolist() == w.ids for i, w in enumerate(want))
    words = Tokenizer.from_file(WORD)
    assert counter(WORD).counts(pa.array(texts)).tolist() == [len(w.ids) for w in words.encode_batch(texts, add_special_tokens=False)]


def test_counts_whole_table(docs):
    words = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, count_tokens(docs, WORD, limit=100).collect()))
    want = []
    for i, t, *_ in rows():
        n = len(words.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want)


def test_packing_is_gapless_and_complete(docs):
    got = pack_documents(docs, BYTE).collect()
    want = []
    for i, t, *_ in rows():
        ids = true_ids(t)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(i, n, lo, hi - lo, crc(ids[lo:hi])) for n, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(w[3] for w in want) // 2048)


def optimum(lengths, size):
    """The least number of bins, by trying every place for every piece, longest first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i] and free[k] not in free[:k]:
                place(i + 1, [*free[:k], free[k] - lengths[i], *free[k + 1 :]])
        place(i + 1, [*free, size - lengths[i]])

    place(0, [])
    return best


def held(plan, size, lengths):
    used = {}
    for chosen, times in plan.fillings:
        assert sum(chosen) <= size and times > 0
        for x in chosen:
            used[x] = used.get(x, 0) + times
    values, counts = np.unique(lengths, return_counts=True)
    assert used == dict(zip(values.tolist(), counts.tolist()))


def test_plan_is_the_optimum_of_small_cases():
    rng = random.Random(17)
    cases = [[694, 573, 875, 905, 459, 815, 738, 703]]
    cases += [[rng.randint(1, 2048) if k % 3 else rng.randint(400, 950) for _ in range(rng.randint(6, 11))] for k in range(3000)]
    cases += [[rng.choice([300, 500, 700, 683, 1024]) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    for lengths in cases:
        values, counts = np.unique(lengths, return_counts=True)
        plan = complete_bins(values.tolist(), counts.tolist())
        held(plan, 2048, lengths)
        assert plan.finished and plan.sequences == optimum(lengths, 2048) >= plan.bound, lengths


def test_plan_of_many_pieces():
    rng = np.random.default_rng(0)
    for lengths in (np.minimum(2048, np.maximum(1, rng.lognormal(6.3, 1, 4000).astype(int))), rng.integers(500, 1100, 3000), np.ones(5000, int), np.full(40, 2048)):
        values, counts = np.unique(lengths, return_counts=True)
        plan = complete_bins(values.tolist(), counts.tolist(), nodes=3000)
        held(plan, 2048, lengths)
        assert plan.sequences <= plan.bound * 1.1 + 1 and (plan.finished or plan.sequences > plan.bound)
    assert complete_bins([1025, 1024], [3, 1]).sequences == 4
    assert complete_bins([], []).fillings == []


def test_store_round_trip(docs):
    got = sorted(map(tuple, store_and_read(docs, BYTE).collect()))
    want, start = [], 0
    for i, t, *_ in sorted(rows(), key=lambda r: r[0]):
        ids = true_ids(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)


def test_store_keeps_each_chunk_once_and_notices_damage(spark, docs, tmp_path):
    from archipel.llm.content_store import read_documents

    places = write_store(docs, str(tmp_path / "store"), BYTE)
    chunks = spark.read.parquet(places["chunks"]).where("kind = 'chunk'")
    stored = [bytes(r["hashes"][i : i + 16]) for r in chunks.collect() for i in range(0, len(r["hashes"]), 16)]
    assert len(stored) == len(set(stored)) == chunks.agg(F.sum("n")).first()[0]
    manifest = spark.read.parquet(places["manifest"])
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows())
    bad = chunks.withColumn("bytes", F.lit(chunks.orderBy(F.octet_length("bytes")).first()["bytes"]))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged"):
        read_documents(spark, places | {"chunks": str(tmp_path / "bad")}).collect()


def test_store_gives_the_ids_back_and_notices_changed_recipes_and_lost_chunks(spark, docs, tmp_path):
    from archipel.llm.content_store import read_documents, read_ids

    places = write_store(docs, str(tmp_path / "store"), BYTE)
    got = sorted((r["doc_id"], r["ids"]) for r in read_ids(spark, places).collect())
    assert got == sorted((i, true_ids(t)) for i, t, *_ in rows())
    recipes = spark.read.parquet(places["recipes"])
    one = recipes.where("doc_id = 8").first()["hashes"]
    changes = {
        "hashes": F.when(F.col("doc_id") == 4, F.lit(one)).otherwise(F.col("hashes")),
        "n": F.when(F.col("doc_id") == 4, 2).otherwise(F.col("n")),
        "doc_id": F.when(F.col("doc_id") == 4, 5000).otherwise(F.col("doc_id")),
    }
    for column, change in changes.items():
        recipes.withColumn(column, change.cast(recipes.schema[column].dataType)).write.parquet(str(tmp_path / column))
        with pytest.raises(ValueError, match="manifest"):
            read_documents(spark, places | {"recipes": str(tmp_path / column)})
    recipes.where("doc_id <> 4").write.parquet(str(tmp_path / "fewer"))
    with pytest.raises(ValueError, match="manifest"):
        read_documents(spark, places | {"recipes": str(tmp_path / "fewer")})
    manifest = spark.read.parquet(places["manifest"])
    manifest.withColumn("root", F.reverse("root")).write.parquet(str(tmp_path / "manifest"))
    with pytest.raises(ValueError, match="manifest"):
        read_documents(spark, places | {"manifest": str(tmp_path / "manifest")})
    chunks = spark.read.parquet(places["chunks"]).where("kind = 'chunk'").orderBy("hashes")
    chunks.offset(1).write.parquet(str(tmp_path / "lost"))
    with pytest.raises(Exception, match="lost"):
        read_documents(spark, places | {"chunks": str(tmp_path / "lost")}).collect()


def test_memory_of_pieces_is_bounded_and_loses_nothing():
    from archipel.llm.token_memo import PieceMemo, Recent

    few = Recent(2000)
    for i in range(100):
        few.put(str(i), i, 8)
        few.put("hot", -1, 8) if few.find(["hot"]) == [None] else None
    assert len(few.now) + len(few.old) < 14 and few.find(["hot", "5"]) == [-1, None]
    small, texts = PieceMemo(BYTE, 3000), pa.array([f"some words {i} of text {i * 7}" for i in range(200)])
    assert (small.encode(texts)[0] == memo(BYTE).encode(texts)[0]).all()


def test_a_worker_asks_for_two_hundred_thousand_pieces_once(monkeypatch):
    from archipel.llm import token_memo

    monkeypatch.setattr(token_memo, "_MEMOS", {})
    own, asked = memo(BYTE), []
    monkeypatch.setattr(own, "library", lambda texts: asked.append(len(texts)) or [b"ab"] * len(texts))
    texts = pa.array([" ".join(f"q{i}" for i in range(lo, lo + 1000)) for lo in range(0, 200_000, 1000)])
    own.encode(texts)
    first = sum(asked)
    own.encode(texts)
    assert 200_000 <= first == sum(asked)


def test_unknown_words_are_asked_together_and_fall_apart_again(monkeypatch):
    from archipel.llm.token_memo import PieceMemo

    rng, own = random.Random(12), PieceMemo(BYTE, 1 << 20)
    words = ["".join(rng.choice("abÄé的ß9,.!-\t\u00a0") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    words = [w for w in words if not w[0].isspace()] + ["a \u00a0 \u00a0", "x<|endoftext|>y", "\u0120", "Ġw"]
    want, asked = own.library([" " + w for w in words]), []
    library = own.library
    monkeypatch.setattr(own, "library", lambda texts: asked.append(len(texts)) or library(texts))
    assert own.after_spaces(words) == want and own.after_spaces([]) == []
    assert sum(asked) < len(words) / 10
    own.known.now.clear()
    assert own.of_pieces(["\x02start", *words[:50], "\x02."]) == [*library(["start"]), *want[:50], *library(["."])]


def test_kernels():
    assert joined_crc32([zlib.crc32(b"ab"), zlib.crc32(b"c" * 5000), zlib.crc32(b"")], [2, 5000, 0]) == zlib.crc32(b"ab" + b"c" * 5000)
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u2")
    cuts = cut_points(ids, np.array([0, 10, 20000]))
    assert cuts[0] == 0 and cuts[1] == 10 and (np.diff(cuts)[1:] >= 64).all() and np.diff(np.append(cuts, 20000)).max() <= 4096
    shifted = cut_points(np.insert(ids, 10, [1, 2, 3]).astype("<u2"), np.array([0, 10, 20003])) - 3
    assert len(set(cuts.tolist()) & set(shifted.tolist())) > 20
    assert merkle_root([]) != merkle_root([b"a"]) == b"a"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack_documents(empty, BYTE).count() == store_and_read(empty, BYTE).count() == count_tokens(empty, WORD).count() == 0


def test_slices_of_a_batch_hold_their_own_texts():
    from archipel.llm.minhash import word_hashes
    from archipel.llm.token_memo import text_slices

    random.seed(8)
    texts = ["".join(random.choice("aÄé ßZ\n的.") for _ in range(random.randint(0, 300))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    parts = list(text_slices(batch, 1, 5000))
    assert len(parts) > 10 and [t for p in parts for t in p.column(1).to_pylist()] == texts
    words, ids = counter(WORD), memo(BYTE)
    for part in parts:
        own = part.column(1)
        whole = pa.array(own.to_pylist())
        assert (word_hashes(own)[0] == word_hashes(whole)[0]).all() and (word_hashes(own)[1] == word_hashes(whole)[1]).all()
        assert (words.counts(own) == words.counts(whole)).all() and (ids.encode(own)[0] == ids.encode(whole)[0]).all()
