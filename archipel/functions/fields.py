"""Bits and numbers of archive headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
#: File type bits, hosts with Unix modes, DOS attribute bits, general purpose flag bits.
S_IFMT, S_IFREG, S_IFDIR, S_IFLNK = 0o170000, 0o100000, 0o040000, 0o120000
UNIX_HOSTS = [3, 19]
DOS_READONLY, DOS_DIRECTORY = 0x01, 0x10
ENCRYPTED, DESCRIPTOR, STRONG, UTF8 = 0x0001, 0x0008, 0x0040, 0x0800
#: Compression methods by code, and what version reads them.
METHOD_NAMES = {
    0: "stored", 1: "shrunk", 2: "reduced", 3: "reduced", 4: "reduced", 5: "reduced", 6: "imploded", 8: "deflate", 9: "deflate64",
    10: "PKWARE DCL imploded", 12: "bzip2", 14: "lzma", 16: "IBM z/OS CMPSC", 18: "IBM TERSE", 19: "IBM LZ77", 93: "zstd", 94: "mp3",
    95: "xz", 96: "JPEG variant", 97: "WavPack", 98: "PPMd", 99: "AE-x encryption marker",
}
DECODABLE = [0, 1, 2, 3, 4, 5, 6, 8, 9, 12, 14, 93, 95, 98]
METHOD_VERSION = {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 10, 6: 10, 8: 20, 9: 20, 12: 46, 14: 63, 93: 63, 95: 63, 98: 63}
#: Encryption schemes with strength code, salt length, bytes added, version needed.
SCHEMES = [("aes256", 3, 16, 28, 51), ("aes192", 2, 12, 24, 51), ("aes128", 1, 8, 20, 51), ("zipcrypto", None, None, 12, 20)]


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def _lookup(key: Column, table: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def method_name(code: Column) -> Column:
    return _lookup(code, METHOD_NAMES, "unknown")


def level_flags(level: Column) -> Column:
    """General purpose bits that tell the compression level."""
    return _lookup(level, {"best": 0b010, "default": 0b000, "fast": 0b100, "none": 0b110}, None)


def bzip2_block_size(level: Column) -> Column:
    return _lookup(level, {"none": 1, "fast": 1, "default": 9, "best": 9}, None)


def version_needed(method: Column, zip64: Column, aes: Column) -> Column:
    return F.greatest(_lookup(method, METHOD_VERSION, 10), F.when(zip64, 45).otherwise(0), F.when(aes, 51).otherwise(0))


def needs_zip64(compressed: Column, size: Column, offset: Column) -> Column:
    return (compressed >= U32) | (size >= U32) | (offset >= U32)


def saturated(value: Column, most: int = U32) -> Column:
    return F.least(value, F.lit(most))


def host_of(version_made_by: Column) -> Column:
    return F.shiftright(version_made_by, 8)


def version_of(version_made_by: Column) -> Column:
    return version_made_by.bitwiseAND(0xFF)


def made_by(host: Column, version: Column) -> Column:
    return host * 256 + version


def _unix_mode(external: Column, version_made_by: Column) -> Column:
    return F.when(host_of(version_made_by).isin(UNIX_HOSTS), F.shiftrightunsigned(external, 16)).otherwise(0)


def attribute_kind(external: Column, version_made_by: Column, name_is_dir: Column) -> Column:
    """symlink before directory before file."""
    mode = _unix_mode(external, version_made_by).bitwiseAND(S_IFMT)
    return F.when(mode == S_IFLNK, "symlink").when(name_is_dir | (mode == S_IFDIR) | bit(external, DOS_DIRECTORY), "directory").otherwise("file")


def attribute_mode(external: Column, version_made_by: Column) -> Column:
    """Permission bits, null where no Unix mode is stored."""
    mode = _unix_mode(external, version_made_by)
    return F.when(mode != 0, mode.bitwiseAND(0o7777))


def effective_mode(kind: Column, mode: Column, dos_attrs: Column) -> Column:
    """Stored permissions, or the usual ones of the kind: 755, 777, 444 for read-only files, 644."""
    default = F.when(kind == "directory", 0o755).when(kind == "symlink", 0o777).when(bit(F.coalesce(dos_attrs, F.lit(0)), DOS_READONLY), 0o444).otherwise(0o644)
    own = mode.bitwiseAND(0o7777)
    return F.when(mode.isNotNull() & (own != 0), own).otherwise(default)


def is_readonly(mode: Column, dos_attrs: Column) -> Column:
    """The DOS attribute; without one, no write bit for the owner in the mode."""
    return F.coalesce(bit(dos_attrs, DOS_READONLY), ~bit(mode, 0o200), F.lit(False))


def attributes(kind: Column, mode: Column, dos_attrs: Column) -> Column:
    """External attributes as a Unix host writes them."""
    dos = F.coalesce(dos_attrs, F.lit(0)).bitwiseOR(F.when(kind == "directory", DOS_DIRECTORY).otherwise(0)).bitwiseOR(F.when(is_readonly(mode, dos_attrs), DOS_READONLY).otherwise(0))
    kinds = F.when(kind == "directory", S_IFDIR).when(kind == "symlink", S_IFLNK).otherwise(S_IFREG)
    return kinds.bitwiseOR(effective_mode(kind, mode, dos_attrs)).cast("long") * 65536 + dos


def effective_method(method: Column, aes_method: Column) -> Column:
    return F.when(method == 99, F.coalesce(aes_method, method)).otherwise(method)


def encryption_of(flags: Column, aes_strength: Column) -> Column:
    strength = _lookup(aes_strength, {1: "aes128", 2: "aes192", 3: "aes256"}, None)
    return F.when(~bit(flags, ENCRYPTED), F.lit(None)).when(aes_strength.isNotNull(), strength).otherwise("zipcrypto")


def readability(flags: Column, method: Column, aes_method: Column, has_password: Column) -> Column:
    """ok, or why an entry cannot be read."""
    return (
        F.when(bit(flags, STRONG), "strong_encryption")
        .when(bit(flags, ENCRYPTED) & ~has_password, "password_required")
        .when(~effective_method(method, aes_method).isin(DECODABLE), "unsupported_method")
        .otherwise("ok")
    )


def size_class(size: Column, threshold: int = 8 << 20) -> Column:
    return F.when(size <= threshold, "small").otherwise("large")


def tar_padding(size: Column, block: int = 512) -> Column:
    return F.pmod(-size, F.lit(block))


def tar_end(size: Column, record: int = 10240) -> Column:
    """The length of a tar of `size` bytes of entries: two zero blocks, then up to a full record."""
    ended = size + 1024
    return ended + F.pmod(-ended, F.lit(record))


def octal_field(value: Column, width: int) -> Column:
    """Zero-padded octal digits that leave room for a NUL."""
    return F.lpad(F.conv(value.cast("string"), 10, 8), width - 1, "0")


def parse_octal(text: Column) -> Column:
    digits = F.regexp_extract(text, "^[ \0]*([0-7]*)", 1)
    return F.when(digits == "", 0).otherwise(F.conv(digits, 8, 10).cast("long")).cast("long")


def little_endian(value: Column, width: int) -> Column:
    """A number as `width` bytes, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))))


def from_little_endian(data: Column, offset: int, width: int) -> Column:
    """The number in `width` bytes from `offset` on; null where the data ends before."""
    part = F.substring(data, offset + 1, width)
    digits = F.concat(*(F.substring(F.hex(part), 2 * i + 1, 2) for i in reversed(range(width))))
    return F.when(F.octet_length(part) == width, F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long"))


def lzma_props(lc: Column, lp: Column, pb: Column) -> Column:
    return (pb * 5 + lp) * 9 + lc


def lzma_fields(props: Column) -> Column:
    rest = F.floor(props / 9)
    return F.when((props >= 0) & (props < 225), F.struct((props % 9).cast("int").alias("lc"), (rest % 5).cast("int").alias("lp"), F.floor(rest / 5).cast("int").alias("pb")))


def lzma2_dictionary(code: Column) -> Column:
    """Dictionary bytes of an LZMA2 property: 2 or 3 times a power of two; 40 is 4 GiB less one."""
    size = (2 + code.bitwiseAND(1)).cast("long") * F.pow(F.lit(2), F.floor(code / 2) + 11).cast("long")
    return F.when(code == 40, F.lit(U32).cast("long")).when(code.between(0, 39), size)


def lzip_dictionary(code: Column) -> Column:
    """Dictionary bytes of a lzip header: a power of two less some sixteenths of it."""
    base = F.pow(F.lit(2), code.bitwiseAND(31)).cast("long")
    return F.when(code.bitwiseAND(31).between(12, 29), base - F.floor(base / 16) * F.shiftright(code, 5))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), done * 100.0 / total))


def thread_count(requested: Column, available: Column, items: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.when(requested > 0, requested).otherwise(available), available, items))


def pax_record(key: Column, value: Column) -> Column:
    """`<length> key=value\\n`, where the length counts its own digits."""
    body = F.octet_length(key) + F.octet_length(value) + 3
    digits = F.length(body.cast("string"))
    once = body + digits
    length = body + F.length(once.cast("string"))
    return F.concat(length.cast("string"), F.lit(" "), key, F.lit("="), value, F.lit("\n"))


def pax_seconds(value: Column) -> Column:
    """Whole seconds of a PAX time; null if it is no number."""
    return F.substring_index(value, ".", 1).try_cast("long")


def verify(size: Column, crc: Column, content: Column) -> Column:
    """ok, size_mismatch, or checksum_mismatch: the size is tested first."""
    return F.when(F.octet_length(content) != size, "size_mismatch").when(F.crc32(content) != crc, "checksum_mismatch").otherwise("ok")


def valid_sparse(segments: Column, real_size: Column) -> Column:
    """Segments ascend, do not overlap, and stay within the real size."""
    reach = F.aggregate(segments, F.lit(0).cast("long"), lambda at, s: F.when((at < 0) | (s["offset"] < at) | (s["length"] < 0), F.lit(-1).cast("long")).otherwise(s["offset"] + s["length"]))
    return (reach >= 0) & (reach <= real_size)


def sparse_stored(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("long"), lambda at, s: at + s["length"])


def sparse_text(segments: Column) -> Column:
    """A PAX 1.0 map: the number of segments, then offset and length of each, a line each."""
    flat = F.flatten(F.transform(segments, lambda s: F.array(s["offset"], s["length"])))
    return F.concat(F.array_join(F.concat(F.array(F.size(segments).cast("long")), flat), "\n"), F.lit("\n"))


def sparse_pays(segments: Column, real_size: Column, least: int = 1 << 20) -> Column:
    """Whether data, map and a block of padding are smaller than the file; small files stay whole."""
    return (real_size >= least) & (sparse_stored(segments) + F.octet_length(sparse_text(segments)) + 512 < real_size)
