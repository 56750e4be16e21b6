"""Entry names as column expressions: safety rules, selection, stripping, volume and header names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that Windows reserves, and characters it forbids.
WINDOWS_RESERVED = [
    "CON", "PRN", "AUX", "NUL",
    "COM0", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT0", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]
WINDOWS_ILLEGAL = r'[<>:"|?*]'


def components(name: Column) -> Column:
    """Parts between slashes of either kind, without empty ones and `.`."""
    return F.filter(F.split(name, r"[/\\]"), lambda c: (c != "") & (c != "."))


def relative(name: Column) -> Column:
    return F.array_join(components(name), "/")


def is_rooted(name: Column) -> Column:
    return name.rlike(r"^[/\\]")


def has_drive(name: Column) -> Column:
    return name.rlike("^[A-Za-z]:")


def has_directory_suffix(name: Column) -> Column:
    return name.rlike(r"[/\\]$")


def _windows_refuses(part: Column) -> Column:
    stem = F.upper(F.substring_index(part, ".", 1))
    return part.rlike(WINDOWS_ILLEGAL) | part.rlike("[. ]$") | stem.isin(WINDOWS_RESERVED)


def rejection(name: Column, strict: bool = False) -> Column:
    """Why a name must not be extracted (empty, illegal_character, absolute, parent_traversal), or null if it is safe.

    Of several faults in the parts of a name the leftmost counts.
    """
    parts = components(name)
    out = F.when(name == "", "empty").when(name.rlike(r"[\x00-\x1f\x7f]"), "illegal_character").when(is_rooted(name), "absolute")
    if strict:
        out = out.when(has_drive(name), "absolute")
        fault = F.transform(parts, lambda c: F.when(c == "..", "parent_traversal").when(_windows_refuses(c), "illegal_character"))
        first = F.get(F.filter(fault, lambda f: f.isNotNull()), F.lit(0))
        out = out.when(first.isNotNull(), first)
    else:
        out = out.when(F.array_contains(parts, ".."), "parent_traversal")
    return out.when(F.size(parts) == 0, "empty")


def strip_leading(name: Column, count: Column | int) -> Column:
    parts = components(name)
    return F.array_join(F.slice(parts, F.lit(count) + 1, F.greatest(F.size(parts), F.lit(1))), "/")


def is_archive_root(name: Column) -> Column:
    return F.rtrim(name, F.lit("/")).isin("", ".")


def selected(name: Column, wanted: list[str]) -> Column:
    """An exact name, or anything below a named directory; an empty selection is everything."""
    if not wanted:
        return F.lit(True)
    bare = F.rtrim(name, F.lit("/"))
    out = F.lit(False)
    for want in wanted:
        w = want.rstrip("/")
        out = out | (bare == w) | bare.startswith(w + "/")
    return out


def symlink_escapes(link: Column, target: Column) -> Column:
    """Whether a link at relative path `link` points out of the archive's root."""
    depth = F.size(components(link)) - 1
    walked = F.aggregate(
        F.split(target, r"[/\\]"),
        depth,
        lambda at, part: F.when(at < 0, F.lit(-1)).when(part.isin("", "."), at).when(part == "..", at - 1).otherwise(at + 1),
    )
    return is_rooted(target) | has_drive(target) | (walked < 0)


def entry_name(path: Column, is_dir: Column) -> Column:
    """The archive name of a relative path; null where it climbs up or is empty."""
    parts = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))
    name = F.concat(F.array_join(parts, "/"), F.when(is_dir, "/").otherwise(""))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), name)


def stored_name(name: Column, is_dir: Column) -> Column:
    """A name as ZIP stores it: forward slashes, and one at the end of directories."""
    out = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.when(is_dir & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def needs_utf8_flag(name: Column) -> Column:
    return F.octet_length(name) > F.char_length(name)


def ustar_split(name: Column) -> Column:
    """struct(prefix, rest) of a name in a ustar header, null where it does not fit (bytes; ASCII names)."""
    short = F.octet_length(name) <= 100
    head = F.substring(name, 1, 156)
    cut = F.length(head) - F.locate("/", F.reverse(head)) + 1  # the last slash that leaves a prefix of 155
    fits = (F.locate("/", head) > 0) & (F.length(name) - cut <= 100) & (F.length(name) - cut > 0) & (cut > 1)
    split = F.struct(F.expr("''").alias("prefix"), name.alias("rest"))
    long = F.struct(F.substring(name, F.lit(1), cut - 1).alias("prefix"), F.substring(name, cut + 1, F.length(name)).alias("rest"))
    return F.when(short, split).when(fits, long)


def trimmed_field(value: Column) -> Column:
    """A header field: up to the first NUL, without closing spaces."""
    return F.rtrim(F.substring_index(value, "\0", 1))


def default_directory(path: Column) -> Column:
    """Where an archive is extracted by default: its name without the last extension."""
    return F.when(path.rlike(r"[^/]\.[^./]*$"), F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(path)


def volume_name(stem: Column, number: Column) -> Column:
    """`stem.z01`, `.z02`, ... of a split archive."""
    return F.format_string("%s.z%02d", stem, number)


def piece_name(path: Column, number: Column) -> Column:
    """`path.001`, `.002`, ... of a raw split."""
    return F.format_string("%s.%03d", path, number)


def volume_base(path: Column) -> Column:
    """The archive that a volume's name belongs to: `x.z07` and `x.zip` to `x.zip`, `x.zip.003` to `x.zip`."""
    return F.when(path.rlike(r"(?i)\.z\d{2,}$"), F.regexp_replace(path, r"(?i)\.z\d{2,}$", ".zip")).when(path.rlike(r"\.\d{3,}$"), F.regexp_replace(path, r"\.\d{3,}$", "")).otherwise(path)
