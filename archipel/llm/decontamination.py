"""Benchmark decontamination by template canonicalisation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipel.llm.common import pick, written

#: Placeholders for names, numbers and units.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units that may follow a number.
UNITS = (
    "km|cm|mm|m|kg|mg|g|t|l|ml|s|ms|min|h|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|a|j|n|pa|k|mi|ft|in|yd|lb|lbs|oz|"
    "meters|metres|miles|feet|inches|grams|kilograms|pounds|ounces|litres|liters|seconds|minutes|hours|days|weeks|months|years|"
    "dollars|cents|euros|percent|degrees"
)
#: One or more capitalised words after a word or comma: inside a sentence, so not its first word.
NAME_PATTERN = r"([\p{L}\p{N},;] )\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"
NUMBER_PATTERN = r"\p{N}+(?:[.,:/]\p{N}+)*"
UNIT_PATTERN = rf"{NUMBER} +({UNITS})([^\p{{L}}])"
GAP_PATTERN = rf"[^\p{{L}}{NAME}-{UNIT}]+"

#: The same for Java, which recurses at each turn of a repeated group unless it may not go back: a thousand names in a row
#: overflow a task's stack, which ends the executor. What follows a turn here never begins with what the turn may give back,
#: so both forms match the same.
_JAVA_NAME = r"([\p{L}\p{N},;] )\p{Lu}\p{L}*+(?: \p{Lu}\p{L}*+)*+"
_JAVA_NUMBER = r"\p{N}++(?:[.,:/]\p{N}++)*+"

#: Above this many windows the benchmark side is shuffled, not broadcast.
BROADCAST_WINDOWS = 2_000_000


def _named(text: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _JAVA_NAME, f"$1 {NAME} ")


def _numbered(named: Column) -> Column:
    return F.regexp_replace(F.lower(named), _JAVA_NUMBER, f" {NUMBER} ")


def template(text: Column) -> Column:
    """The words of a text, lower-cased, with placeholders for names, numbers and units; marks between words are dropped."""
    numbered = _numbered(_named(text))
    united = F.when(F.instr(numbered, NUMBER) > 0, F.regexp_replace(numbered, UNIT_PATTERN, f"{NUMBER} {UNIT} $2")).otherwise(numbered)
    return F.split(united, GAP_PATTERN)


def windows(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, pos, window): the hash of every run of `width` template words."""
    words = df.select(F.col(id_col).alias("id"), template(F.col(text_col)).alias("words"))
    hashed = words.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= width)
    runs = F.transform(F.sequence(F.lit(0), F.size("h") - width), lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(width))))
    return hashed.select("id", F.posexplode(runs).alias("pos", "window"))


def slots(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, value) of every name, number and unit: where it stands among the template words, and what it says."""
    text = F.col(text_col)
    named = _named(text)
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    found = {NAME: F.transform(F.regexp_extract_all(padded, F.lit(_JAVA_NAME), F.lit(0)), lambda v: F.lower(v.substr(F.lit(3), F.length(v)))), NUMBER: F.regexp_extract_all(F.lower(named), F.lit(_JAVA_NUMBER), F.lit(0)), UNIT: F.regexp_extract_all(_numbered(named), F.lit(UNIT_PATTERN), F.lit(1))}
    base = df.select(F.col(id_col).alias("id"), F.transform(template(text), lambda w, i: F.struct(w.alias("w"), i.alias("i"))).alias("words"), F.array(*(values.alias(mark) for mark, values in found.items())).alias("found"))

    def places(mark: str) -> Column:
        return F.transform(F.filter("words", lambda x: x["w"] == F.lit(mark)), lambda x: x["i"])

    out = None
    for k, mark in enumerate(found):
        own = base.select("id", F.explode(F.arrays_zip(places(mark).alias("pos"), F.get("found", F.lit(k)).alias("value"))).alias("s")).select("id", "s.pos", "s.value")
        out = own if out is None else out.unionByName(own)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, least_literal: int = 3, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage) of every document that holds a benchmark item.

    Both sides become templates: numbers, names inside sentences and units turn into typed
    placeholders, case and marks are dropped. Windows of `width` template words join by
    hash; windows with fewer than `least_literal` literal words prove nothing and are left
    out. At each distance between a document and an item the values in matched slots must
    map one to one (the same item value always to the same document value and back); where
    they do not, only windows without slots count. An item is held if `coverage` of its
    windows are matched.

    One pass over the texts without a shuffle where the benchmark's windows are few enough
    to broadcast (counted first); otherwise the windows meet in a shuffle join. Only
    matches are shuffled. Items of fewer than `width` words, null texts and blank texts
    have no windows; texts of any length are read whole. Null ids are left out; of
    repeated ids each text is looked at by itself, and the one that holds most counts. Each row of the result is one pair, however often the item occurs
    in the document; ties do not arise. Other columns of either table are not read, whatever
    their names. An empty table on either side gives an empty result.
    """
    clean = docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row")).alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    words = items.select("item_id", template(F.col("text")).alias("words"))
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.slice(F.col("words"), i + 1, width))
    runs = words.where(F.size("words") >= width).select("item_id", F.posexplode(runs).alias("item_pos", "run"))
    marks = [NAME, NUMBER, UNIT, ""]
    literal = F.size(F.filter("run", lambda w: ~w.isin(marks)))
    has_slot = F.exists("run", lambda w: w.isin(NAME, NUMBER, UNIT))
    window = F.xxhash64(*(F.xxhash64(F.get("run", F.lit(k))) for k in range(width)))
    wanted = written(runs.where((literal >= least_literal) & ~F.array_contains("run", "")).select("item_id", "item_pos", has_slot.alias("has_slot"), window.alias("window")), "windows")
    n_wanted = wanted.count()
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_WINDOWS else wanted
    hits = windows(clean, "doc", "text", width).join(side, "window").select(F.col("id").alias("doc"), "item_id", "item_pos", "has_slot", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = written(hits, "hits")
    # Slots of matched windows, on both sides.
    item_slots = slots(items, "item_id", "text").select(F.col("id").alias("item_id"), F.col("pos").alias("slot"), F.col("value").alias("item_value"))
    in_slots = hits.where("has_slot").join(item_slots, "item_id").where(F.col("slot").between(F.col("item_pos"), F.col("item_pos") + width - 1)).select("doc", "item_id", "shift", "slot", "item_value").distinct()
    slotted = pick(clean, "doc_id", written(hits.where("has_slot").select("doc.doc_id").distinct(), "slotted"), "left_semi")
    doc_slots = slots(slotted, "doc", "text").select(F.col("id").alias("doc"), F.col("pos").alias("at"), F.col("value").alias("doc_value"))
    bound = in_slots.withColumn("at", F.col("slot") + F.col("shift")).join(doc_slots, ["doc", "at"])
    pairs = bound.groupBy("doc", "item_id", "shift").agg(F.countDistinct("item_value", "doc_value").alias("n"), F.countDistinct("item_value").alias("ni"), F.countDistinct("doc_value").alias("nd"))
    clash = pairs.where("n <> ni or n <> nd").select("doc", "item_id", "shift", F.lit(True).alias("clash"))
    counted = hits.join(clash, ["doc", "item_id", "shift"], "left").where("not has_slot or clash is null")
    matched = counted.groupBy("doc", "item_id").agg(F.countDistinct("item_pos").alias("n")).groupBy("doc.doc_id", "item_id").agg(F.max("n").alias("n_matched"))
    sizes = wanted.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_windows"))
    return matched.join(sizes, "item_id").where(F.col("n_matched") >= coverage * F.col("n_windows")).select("doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"))
