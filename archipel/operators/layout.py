"""Where entries go: placement, collisions, links, offsets, volumes and summaries, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions import paths


def strip_root_depth(entries: DataFrame, group: str = "archive") -> DataFrame:
    """(group, root_depth): 1 where all names of a group share their first part and one lies deeper, else 0. A `./` root does not count."""
    named = entries.where(~paths.is_archive_root(F.col("name"))).withColumn("__parts", paths.components(F.col("name")))
    first = F.get("__parts", F.lit(0))
    shared = (F.min(first) == F.max(first)) & (F.max(F.size("__parts")) > 1) & (F.min(F.size("__parts")) > 0)
    return named.groupBy(group).agg(F.coalesce(shared.cast("int"), F.lit(0)).alias("root_depth"))


def place(entries: DataFrame, strip: int = 0, strip_root: bool = False, strict: bool = False, unsafe: str = "refuse", selection: list[str] | None = None, group: str = "archive") -> DataFrame:
    """Adds `path` and `status` (placed, refused, stripped) to the selected entries.

    unsafe="refuse" makes an unsafe name fail the job, "skip" keeps its row as refused.
    """
    chosen = entries.where(paths.selected(F.col("name"), selection or []))
    depth: Column = F.lit(strip)
    if strip_root:
        chosen = chosen.join(strip_root_depth(chosen, group), group, "left")
        depth = depth + F.coalesce("root_depth", F.lit(0))
    why = paths.rejection(F.col("name"), strict)
    parts = paths.components(F.col("name"))
    path = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    refused: Column = F.lit("refused")
    if unsafe == "refuse":
        refused = F.raise_error(F.concat(F.lit("unsafe entry path: "), F.col("name"), F.lit(" ("), why, F.lit(")"))).cast("string")
    status = F.when(why.isNotNull(), refused).when(path == "", "stripped").otherwise("placed")
    out = chosen.withColumn("status", status).withColumn("path", F.when(F.col("status") == "placed", path))
    return out.drop("root_depth")


def resolve_collisions(placed: DataFrame, overwrite: str = "always", group: str = "archive") -> DataFrame:
    """One entry for each path: the last ("always") or the first ("never"); "error" fails the job on a second one.

    Adds `slot`, the place of the path's first claimant, and marks losers as `collided`.
    Directories never collide.
    """
    is_file = (F.col("status") == "placed") & (F.col("kind") != "directory")
    claim = Window.partitionBy(group, "path", is_file)
    order = F.col("ordinal").desc() if overwrite == "always" else F.col("ordinal").asc()
    rank = F.row_number().over(claim.orderBy(order))
    lost = is_file & (F.col("__rank") > 1)
    marked = placed.withColumn("__rank", rank).withColumn("slot", F.when(is_file, F.min("ordinal").over(claim)).otherwise(F.col("ordinal")))
    collided: Column = F.lit("collided")
    if overwrite == "error":
        collided = F.raise_error(F.concat(F.col("path"), F.lit(" appears twice"))).cast("string")
    return marked.withColumn("status", F.when(lost, collided).otherwise(F.col("status"))).drop("__rank")


def extract_summary(entries: DataFrame) -> DataFrame:
    """Counts of what an extraction does: one row."""
    done = F.col("status") == "placed"
    kinds = {"files": "file", "directories": "directory", "symlinks": "symlink", "hardlinks": "hardlink", "specials": "special"}
    return entries.agg(
        *(F.count_if(done & (F.col("kind") == k)).alias(name) for name, k in kinds.items()),
        F.count_if(F.col("status").isin("stripped", "collided")).alias("skipped"),
        F.count_if(F.col("status") == "refused").alias("refused"),
        F.coalesce(F.sum(F.when(done & (F.col("kind") == "file"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )


def hard_links(sources: DataFrame, inode: list[str]) -> DataFrame:
    """Adds `link_to`: the first name with the same inode, for every later one."""
    same = Window.partitionBy(*inode).orderBy("name")
    return sources.withColumn("link_to", F.when(F.row_number().over(same) > 1, F.first("name").over(same)))


def resolve_links(links: DataFrame, extracted: DataFrame) -> DataFrame:
    """Links (path, target) with `resolved`: whether the target was extracted; the others are skipped."""
    have = extracted.select(F.col("path").alias("target")).distinct().withColumn("__have", F.lit(True))
    return links.join(have, "target", "left").withColumn("resolved", F.col("__have").isNotNull()).drop("__have")


def with_offsets(records: DataFrame, length: str, order: str, group: str) -> DataFrame:
    """Adds `offset`: the lengths of all earlier records of the group."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def volume_of(offset: Column, size: int) -> Column:
    """The volume, from 0, that a byte lies in; sizes are clamped to 64 KiB ... 4 GiB - 1."""
    clamped = min(max(size, 64 << 10), (4 << 30) - 1)
    return F.floor(offset / clamped).cast("long")


def locate(offsets: DataFrame, layout: DataFrame) -> DataFrame:
    """Joins (archive, offset) with the volume (archive, volume, start, length) that holds it; past the end: none.

    A volume lies in at most two cells as wide as its length rounded up to a power of two; an
    offset asks in its own cell of each width there is (64 at most), so the join is by key.
    """
    width = F.ceil(F.log2(F.col("length"))).cast("int")
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.col("length"))

    def cell(place: Column) -> Column:
        return F.call_function("shiftright", place.cast("long"), F.col("__width"))

    sized = layout.where("length > 0").withColumn("__width", width)
    last = F.col("start") + F.col("length") - 1
    dealt = sized.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(last)))))
    asked = offsets.crossJoin(F.broadcast(sized.select("__width").distinct())).withColumn("__cell", cell(F.col("offset")))
    found = asked.join(dealt, ["archive", "__width", "__cell"]).where(inside)
    return found.drop("__width", "__cell").withColumn("within", F.col("offset") - F.col("start"))


def directory_order(entries: DataFrame) -> DataFrame:
    """Deepest first, as permissions of directories are set."""
    return entries.orderBy(F.size(paths.components(F.col("name"))).desc(), "name")


def waves(entries: DataFrame, threads: int, budget: int, group: str = "archive") -> DataFrame:
    """Adds `wave`: entries in order go to one wave until `threads` of them or `budget` bytes are reached; the first always fits."""

    def deal(key, frame):
        frame = frame.sort_values("ordinal")
        wave, n, total, out = 0, 0, 0, []
        for size in frame["size"]:
            if n and (n == threads or total + size > budget):
                wave, n, total = wave + 1, 0, 0
            n, total = n + 1, total + size
            out.append(wave)
        return frame.assign(wave=out)

    from pyspark.sql.types import IntegerType, StructField, StructType

    return entries.groupBy(group).applyInPandas(deal, StructType([*entries.schema.fields, StructField("wave", IntegerType())]))


def pax_merge(shared: Column, own: Column) -> Column:
    """Records of an entry win over those that hold for the whole archive."""
    return F.map_concat(F.map_filter(shared, lambda k, v: ~F.map_contains_key(own, k)), own)
