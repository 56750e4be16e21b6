"""Archives against the standard library and hostile input."""

import io
import os
import struct
import subprocess
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from archipel.functions import checksums, codecs, crypto, fields, formats, paths
from archipel.operators import layout
from archipel.operators.extract import create, extract
from archipel.sources import tarfmt, zipfmt
from archipel.sources.archives import entries_of, join_volumes, pack_archives, read_archives, register, split_volumes, write_files

ROWS = "archive string, name string, kind string, content binary, mtime long, mode int"


def noise(size: int, seed: int) -> bytes:
    """A linear congruential generator's bits 16 to 23."""
    state, out = seed | 1, bytearray()
    for _ in range(size):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(state >> 16 & 0xFF)
    return bytes(out)


TREE = [
    ("a", "a.txt", "file", b"hello " * 7000, 1_600_000_000, 0o640),
    ("a", "nested/b.bin", "file", noise(3000, 7), 1_600_000_002, 0o600),
    ("a", "empty.txt", "file", b"", 1_600_000_004, None),
    ("a", "dir/", "directory", None, 1_600_000_006, None),
    ("a", "naïve/ü.txt", "file", "Grüße".encode(), 1_600_000_008, None),
    ("a", "link", "symlink", b"a.txt", 1_600_000_010, None),
]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, ROWS)


def test_the_standard_library_reads_what_is_written(tree):
    data = pack_archives(tree, "archive", "zip", comment="note").first()["content"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.comment == b"note"
        assert {n: z.read(n) for n in z.namelist() if not n.endswith("/")} == {r[1]: r[3] for r in TREE if r[2] != "directory"}
    with tarfile.open(fileobj=io.BytesIO(pack_archives(tree, "archive", "tar.xz").first()["content"])) as t:
        assert sorted(t.getnames()) == sorted(r[1].rstrip("/") for r in TREE)


def test_what_the_standard_library_writes_is_read(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for method, name in ((0, "s"), (8, "d"), (12, "b"), (14, "l")):
            z.writestr(zipfile.ZipInfo(name), b"data " * 500, compress_type=method)
    files = spark.createDataFrame([("x.zip", raw.getvalue())], "path string, content binary")
    assert {r["name"]: r["content"] for r in entries_of(files, content=True).collect()} == dict.fromkeys("sdbl", b"data " * 500)


@pytest.mark.parametrize("scheme", ["aes256", "aes192", "aes128", "zipcrypto"])
def test_encrypted_entries_need_the_right_password(tree, scheme):
    packed = pack_archives(tree, "archive", password=b"pw", encryption=scheme)
    got = {r["name"]: r["content"] for r in entries_of(packed, content=True, password=b"pw").collect()}
    assert got["a.txt"] == b"hello " * 7000
    for password in (None, b"no"):
        with pytest.raises(Exception, match="password"):
            entries_of(packed, content=True, password=password, selection=["a.txt"]).collect()
    assert entries_of(packed).count() == len(TREE)
    if scheme == "zipcrypto":
        with zipfile.ZipFile(io.BytesIO(packed.first()["content"])) as z:
            assert z.read("a.txt", pwd=b"pw") == b"hello " * 7000


def test_aes_known_answers():
    import numpy as np

    key, plain = bytes(range(32)), np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    assert crypto.aes_blocks(key, plain).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.aes_blocks(key[:16], plain).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.ctr(key, crypto.ctr(key, b"abc" * 30)) == b"abc" * 30


def test_checksum_known_answers():
    assert checksums.crc64_bytes(b"123456789").hex() == "995dc9bbdf1939fa"
    assert checksums.bzip2_crc_of(b"123456789") == 0xFC891918
    assert checksums.xxh64_bytes(b"").hex() == "ef46db3751d8e999"
    assert checksums.crc32_joined(zlib.crc32(b"ab"), zlib.crc32(b"cde" * 99), 297) == zlib.crc32(b"ab" + b"cde" * 99)


def test_volumes_in_any_order(spark, tree):
    packed = pack_archives(tree, "archive", method="store")
    pieces = split_volumes(packed, 1000)
    assert pieces.count() > 10
    back = join_volumes(pieces.orderBy(F.rand(1)))
    assert back.first()["content"] == packed.first()["content"]


def test_bytes_do_not_depend_on_partitions(tree):
    assert pack_archives(tree.repartition(1), "archive").first()["content"] == pack_archives(tree.repartition(5), "archive").first()["content"]


def test_damage_is_noticed(spark, tree):
    data = bytearray(pack_archives(tree, "archive", method="store").first()["content"])
    data[60] ^= 1
    files = spark.createDataFrame([("x.zip", bytes(data))], "path string, content binary")
    with pytest.raises(Exception, match="mismatch"):
        entries_of(files, content=True).collect()
    assert entries_of(files).count() == len(TREE)
    with pytest.raises(Exception, match="end of central directory|unknown"):
        entries_of(spark.createDataFrame([("x.zip", b"PK\x03\x04 and no more")], "path string, content binary")).collect()


def test_zip64_and_extra_fields():
    extra = struct.pack("<HHQQ", 1, 16, 5 << 32, 6 << 32) + struct.pack("<HHBI", 0x5455, 5, 1, 2**32 - 5) + struct.pack("<HHBBIBI", 0x7875, 11, 1, 4, 1000, 4, 2000) + b"\x99\x99\x00\x00"
    got = zipfmt.extra_fields(extra, zipfmt.U32, zipfmt.U32, 7, 0)
    assert (got["usize"], got["csize"], got["offset"], got["mtime"], got["uid"], got["gid"]) == (5 << 32, 6 << 32, 7, 2**32 - 5, 1000, 2000)
    assert zipfmt.ending(70_000, 10, 20)[:4] == b"PK\x06\x06"


def test_sparse_files_round_trip(spark):
    data = b"head" + bytes(1 << 20) + b"middle" + bytes(1 << 20) + b"tail"
    packed = pack_archives(spark.createDataFrame([("a", "s.bin", "file", data, 0, None)], ROWS), "archive", "tar", sparse=True)
    row = packed.first()
    assert len(row["content"]) < 20_000
    got = entries_of(packed, content=True).first()
    assert got["content"] == data and got["size"] == len(data) and got["tar"]["sparse"] and got["name"] == "s.bin"
    segments = tarfmt.holes(data)
    assert tarfmt.expand(segments, b"".join(data[o : o + n] for o, n in segments), len(data)) == data


def test_uncompress():
    """Codes of nine bits: A, B, then the pairs that the table holds by then."""
    codes, bits = [65, 66, 257, 259], 0
    for i, c in enumerate(codes):
        bits |= c << 9 * i
    assert codecs._uncompress(b"\x1f\x9d\x90" + bits.to_bytes(5, "little")) == b"ABABABA"


def test_hostile_names_are_refused_or_skipped(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate(["../x", "/x", "a/b", "", "ok/../../x", "."])], "archive string, ordinal int, name string")
    with pytest.raises(Exception, match="unsafe entry path"):
        layout.place(rows).collect()
    got = {r["name"]: r["status"] for r in layout.place(rows, unsafe="skip").collect()}
    assert [n for n, s in got.items() if s == "placed"] == ["a/b"]


def test_collisions(spark):
    rows = spark.createDataFrame([("a", i, n, "file" if not n.endswith("/") else "directory") for i, n in enumerate(["x/d", "y/d", "z/d", "x/e/", "y/e/"])], "archive string, ordinal int, name string, kind string")
    placed = layout.place(rows, strip=1)
    for way, winner in (("always", 2), ("never", 0)):
        kept = layout.resolve_collisions(placed, way).where("status = 'placed'").orderBy("ordinal").collect()
        assert [(r["ordinal"], r["slot"]) for r in kept] == [(winner, 0), (3, 3), (4, 4)]
    with pytest.raises(Exception, match="appears twice"):
        layout.resolve_collisions(placed, "error").collect()


def test_offsets_find_their_volumes_by_key(spark):
    """Volumes of any lengths, overlapping ones, gaps and empty ones; no archive's offsets meet all its volumes."""
    volumes = [(a, v, (v * 37 + k) % 400 - 50, (v * v + k) % 90) for k, a in enumerate("ab") for v in range(60)] + [("a", 99, -3, 1 << 40), ("a", 98, 7, 0)]
    offsets = [(a, o) for a in ("a", "b", "c", None) for o in (-60, -51, -3, 0, 1, 63, 64, 65, 200, 399, 1 << 39, 1 << 41)]
    layout_rows = spark.createDataFrame(volumes, "archive string, volume long, start long, length long")
    got = layout.locate(spark.createDataFrame(offsets, "archive string, offset long"), layout_rows)
    assert got.columns == ["archive", "offset", "volume", "start", "length", "within"]
    expected = [(a, o, v, s, n, o - s) for a, o in offsets for b, v, s, n in volumes if a == b and s <= o < s + n]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert "__cell" in got._jdf.queryExecution().executedPlan().toString().partition("Join [")[2].partition("Inner")[0]


def test_selection_does_not_take_siblings(spark):
    names = ["docs/guide.md", "docs/deep/notes.txt", "docs-extra/other.txt", "docs"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in rows.where(paths.selected(F.col("name"), ["docs/"])).collect()] == ["docs/guide.md", "docs/deep/notes.txt", "docs"]


def test_name_rules(spark):
    cases = {"a\x01": "illegal_character", "C:x": None, "a:b": None, "COM1.txt": None, "..\\x": "parent_traversal", "./.": "empty"}
    strict = {"C:x": "absolute", "ab:c": "illegal_character", "COM1.txt": "illegal_character", "x.": "illegal_character", "x/../COM1": "parent_traversal", "commit": None}
    for table, mode in ((cases, False), (strict, True)):
        rows = spark.createDataFrame([(n,) for n in table], "name string")
        assert {r[0]: r[1] for r in rows.select("name", paths.rejection(F.col("name"), mode)).collect()} == table


def test_formats(spark):
    rows = spark.createDataFrame([(n,) for n in ("a.tar.gz", "a.gz", "dir/b.TGZ", "x.zip", ".zip", "a.tar", ".tar.gz", "zip")], "p string")
    assert [r[0] for r in rows.select(formats.by_suffix(F.col("p"))).collect()] == ["tar.gz", None, "tar.gz", "zip", "zip", "tar", None, None]
    assert formats.formats(spark).count() == 9


def test_waves_and_pax(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 50, 5, 5, 5])], "archive string, ordinal int, size long")
    assert [r["wave"] for r in layout.waves(rows, 2, 12).orderBy("ordinal").collect()] == [0, 1, 2, 2, 3]
    got = spark.range(1).select(fields.pax_record(F.lit("k"), F.lit("v" * 94)).alias("r"), fields.pax_seconds(F.lit("12.9")).alias("s"), layout.pax_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(9))).alias("m")).first()
    assert got["r"].startswith(f"{len(got['r'])} k=v") and got["s"] == 12 and got["m"] == {"a": 9, "b": 2}


def test_files_and_data_source(spark, tree, tmp_path):
    write_files(pack_archives(tree.where("kind = 'file'"), "archive"), str(tmp_path / "in"))
    summary = extract(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert summary["files"] == 4 and (tmp_path / "out/naïve/ü.txt").read_text() == "Grüße"
    made = create(spark, str(tmp_path / "out"), str(tmp_path / "again.tar.gz"), "tar.gz").first()
    assert made["files"] == 4 and read_archives(spark, str(tmp_path / "again.tar.gz")).count() == 4
    register(spark)
    got = spark.read.format("archive").option("content", "true").option("selection", "nested").load(str(tmp_path / "in/a.zip")).collect()
    assert [(r["name"], len(r["content"])) for r in got] == [("nested/b.bin", 3000)]


def test_hard_links_are_extracted(spark, tmp_path):
    rows = spark.createDataFrame([("x", "a.txt", "file", b"same", 1, 420, "i"), ("x", "d/b.txt", "file", b"same", 1, 420, "i"), ("x", "c.txt", "file", b"other", 1, 420, "j")], "archive string, name string, kind string, content binary, mtime long, mode int, inode string")
    write_files(pack_archives(rows, "archive", "tar"), str(tmp_path / "in"))
    extract(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {n: (tmp_path / "out" / n).read_bytes() for n in ("a.txt", "d/b.txt", "c.txt")} == {"a.txt": b"same", "d/b.txt": b"same", "c.txt": b"other"}


def test_writing_does_not_follow_links_out(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "out/d").symlink_to(tmp_path / "elsewhere")
    files = spark.createDataFrame([("d/x.txt", b"x")], "path string, content binary")
    with pytest.raises(Exception, match="leads out"):
        write_files(files, str(tmp_path / "out"))
    assert not list((tmp_path / "elsewhere").iterdir())


def test_refused_options(tree):
    for how in ({"fmt": "tar.Z"}, {"fmt": "tar", "password": b"x"}, {"fmt": "zip", "sparse": True}, {"method": "lzma"}):
        with pytest.raises(ValueError):
            pack_archives(tree, "archive", **how)


def test_stream_lists_new_archives(spark, tree, tmp_path):
    from archipel.streaming.watch import watch

    write_files(pack_archives(tree, "archive"), str(tmp_path / "in"))
    run = watch(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("listed").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("listed").count() == len(TREE)


def test_catalogue_names_match():
    from archipel.plans.catalogue import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80
