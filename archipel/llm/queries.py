"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.llm.common import table

#: The blank characters and the ASCII letters as DuckDB expressions.
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
s AS (SELECT k.doc_id, line, pos, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""

def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.minhash import Sketching, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Sketching(width=2))


_WORDS = f"list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
undirected AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM undirected UNION SELECT r.x, b.y FROM reach r JOIN undirected b ON r.y = b.x),
least AS (SELECT x, min(least(x, y)) AS m FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.x = w.doc_id
"""


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.pitman_yor import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.content_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.toxicity import score_toxicity

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").where(fold != 0))
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op8_sql() -> str:
    """The same templates, windows and slots in DuckDB: re2 has no look-around, and neither has the operator."""
    from archipel.llm import decontamination as d

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def side(name: str, key: str) -> str:
        return f"""
{name}_n AS (SELECT {key}, ' ' || coalesce(text, '') || ' ' AS raw, regexp_replace(' ' || coalesce(text, '') || ' ', {quoted(d.NAME_PATTERN)}, '\\1 {d.NAME} ', 'g') AS named FROM {name} WHERE {key} IS NOT NULL),
{name}_m AS (SELECT {key}, raw, named, regexp_replace(lower(named), {quoted(d.NUMBER_PATTERN)}, ' {d.NUMBER} ', 'g') AS numbered FROM {name}_n),
{name}_w AS (SELECT {key}, raw, named, numbered, regexp_split_to_array(regexp_replace(numbered, {quoted(d.UNIT_PATTERN)}, '{d.NUMBER} {d.UNIT} \\2', 'g'), {quoted(d.GAP_PATTERN)}) AS ws FROM {name}_m),
{name}_r AS (SELECT {key}, unnest(range(len(ws) - 4)) AS pos, unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4])) AS run FROM {name}_w WHERE len(ws) >= 5),
{name}_s AS (
  SELECT {key}, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = '{d.NAME}')) AS slot, lower(substr(unnest(regexp_extract_all(raw, {quoted(d.NAME_PATTERN)})), 3)) AS value FROM {name}_w
  UNION ALL
  SELECT {key}, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = '{d.NUMBER}')), unnest(regexp_extract_all(lower(named), {quoted(d.NUMBER_PATTERN)})) FROM {name}_w
  UNION ALL
  SELECT {key}, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = '{d.UNIT}')), unnest(regexp_extract_all(numbered, {quoted(d.UNIT_PATTERN)}, 1)) FROM {name}_w)"""

    marks = f"'{d.NAME}', '{d.NUMBER}', '{d.UNIT}', ''"
    return f"""
WITH {side("documents", "doc_id")}, {side("benchmark", "item_id")},
wanted AS (SELECT item_id, pos AS item_pos, run, list_contains(run, '{d.NAME}') OR list_contains(run, '{d.NUMBER}') OR list_contains(run, '{d.UNIT}') AS has_slot FROM benchmark_r
  WHERE len(list_filter(run, lambda w: w NOT IN ({marks}))) >= 3 AND NOT list_contains(run, '')),
hits AS (SELECT DISTINCT doc_id, item_id, item_pos, has_slot, pos - item_pos AS shift FROM documents_r JOIN wanted ON documents_r.run = wanted.run),
bound AS (SELECT DISTINCT h.doc_id, h.item_id, h.shift, i.value AS iv, s.value AS dv FROM hits h JOIN benchmark_s i ON i.item_id = h.item_id AND i.slot BETWEEN h.item_pos AND h.item_pos + 4
  JOIN documents_s s ON s.doc_id = h.doc_id AND s.slot = i.slot + h.shift WHERE h.has_slot),
clash AS (SELECT doc_id, item_id, shift FROM bound GROUP BY ALL HAVING count(*) <> count(DISTINCT iv) OR count(*) <> count(DISTINCT dv)),
matched AS (SELECT doc_id, item_id, count(DISTINCT item_pos) AS n FROM hits WHERE NOT has_slot OR (doc_id, item_id, shift) NOT IN (SELECT (doc_id, item_id, shift) FROM clash) GROUP BY ALL),
sizes AS (SELECT item_id, count(DISTINCT item_pos) AS m FROM wanted GROUP BY item_id)
SELECT doc_id, matched.item_id, m::BIGINT AS n_windows, n::BIGINT AS n_matched, n / m AS coverage FROM matched JOIN sizes ON sizes.item_id = matched.item_id WHERE n >= 0.5 * m
"""


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archipel.llm.search import search

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 4))


OP9_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
stats AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w),
p AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.dl / mean))) AS score
  FROM tf q JOIN tf d ON q.term = d.term JOIN df ON df.term = d.term, stats WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10
"""


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup, "op2_pitman_yor": op2_pitman_yor, "op3_best_fit_packing": op3_best_fit_packing, "op4_line_dedup": op4_line_dedup, "op5_token_counts": op5_token_counts, "op6_content_store": op6_content_store, "op7_toxicity": op7_toxicity, "op8_benchmark_decontamination": op8_benchmark_decontamination, "op9_bm25_search": op9_bm25_search, "op10_passage_dedup": op10_passage_dedup}
ORACLE = {"op1_minhash_near_dedup": OP1_SQL, "op4_line_dedup": OP4_SQL, "op8_benchmark_decontamination": _op8_sql(), "op9_bm25_search": OP9_SQL}
