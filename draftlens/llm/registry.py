"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.llm import ann, balltree, chat, decontam, htmltext, jaccard, oracle, packing, quality, repair, simhash, substrings, tokencount, toxicity
from draftlens.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on in Python, in as many parts as there are cores at least."""
    return spread(_table(spark, sf_dir, name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.neighbour_pairs(_table(spark, sf_dir, "conversations")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_texts(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_texts(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_texts(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(_texts(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_table(spark, sf_dir, "conversations"))[0]


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balltree.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", balltree.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(_texts(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_chat_formatting,
        op2_benchmark_decontamination,
        op3_html_extraction,
        op4_token_counts,
        op5_simhash_near_dedup,
        op6_packing,
        op7_nearest_neighbours,
        op8_toxicity,
        op9_quality_classifier,
        op10_substring_dedup,
        op11_conversation_repair,
        op12_centroid_clustering,
        op13_ngram_jaccard,
    )
    return {f.__name__: f for f in own}


_OP1 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT CAST(conv_id >> 1 AS BIGINT) AS pair_id,
         max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN conv_id % 2 <> 0 THEN conv_id END) AS rejected_id
  FROM t GROUP BY 1),
m AS (
  SELECT p.pair_id, coalesce(least(
           (SELECT max(k) FROM t WHERE conv_id = p.chosen_id), (SELECT max(k) FROM t WHERE conv_id = p.rejected_id)), 0) AS most
  FROM p),
d AS (
  SELECT p.pair_id, min(a.k) AS k
  FROM p JOIN t a ON a.conv_id = p.chosen_id JOIN t b ON b.conv_id = p.rejected_id AND a.k = b.k
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
n AS (
  SELECT p.pair_id, p.chosen_id, p.rejected_id,
         CASE WHEN p.chosen_id IS NULL OR p.rejected_id IS NULL THEN 0 ELSE coalesce(d.k - 1, m.most) END AS n
  FROM p JOIN m USING (pair_id) LEFT JOIN d USING (pair_id)),
r AS (
  SELECT conv_id, k, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body, role FROM t),
s AS (
  SELECT conv_id, k, head || body AS line,
         CASE WHEN role = 'assistant' THEN length(head) || ':0,' || length(body) || ':1' ELSE (length(head) + length(body)) || ':0' END AS mask
  FROM r)
SELECT n.pair_id, n.chosen_id, n.rejected_id, CAST(n.n AS BIGINT) AS n_prompt_turns,
       coalesce((SELECT string_agg(line, '' ORDER BY k) FROM s WHERE conv_id = n.chosen_id AND k <= n.n), '') AS prompt,
       coalesce((SELECT string_agg(line, '' ORDER BY k) FROM s WHERE conv_id = n.chosen_id AND k > n.n), '') AS chosen,
       coalesce((SELECT string_agg(mask, ',' ORDER BY k) FROM s WHERE conv_id = n.chosen_id AND k > n.n), '') AS chosen_mask,
       coalesce((SELECT string_agg(line, '' ORDER BY k) FROM s WHERE conv_id = n.rejected_id AND k > n.n), '') AS rejected,
       coalesce((SELECT string_agg(mask, ',' ORDER BY k) FROM s WHERE conv_id = n.rejected_id AND k > n.n), '') AS rejected_mask
FROM n
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""
WITH iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
it AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
ln AS (SELECT DISTINCT n FROM it),
win AS (
  SELECT row, n, i, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT row, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw CROSS JOIN ln WHERE len(w) >= n)),
hit AS (SELECT win.row, win.n, win.i, it.item FROM win JOIN it ON win.n = it.n AND win.run = it.run),
cov AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY row),
its AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (row) LEFT JOIN its USING (row)
"""

_OP10 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT row, doc_id, i, array_to_string(w[i : i + 49], ' ') AS run
  FROM (SELECT row, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM dw WHERE len(w) >= 50)),
first AS (SELECT run, min(doc_id) AS least FROM win GROUP BY run HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT row, unnest(generate_series(i, i + 49)) AS k FROM win JOIN first USING (run) WHERE doc_id > least),
word AS (SELECT row, unnest(w) AS x, unnest(generate_series(1, len(w))) AS k FROM dw),
left_ AS (
  SELECT row, string_agg(x, ' ' ORDER BY k) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (row, k) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM dw LEFT JOIN left_ USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": _OP1,
        "op2_benchmark_decontamination": _OP2,
        "op10_substring_dedup": _OP10,
        "op11_conversation_repair": oracle.OP11,
        "op12_centroid_clustering": oracle.OP12,
        "op13_ngram_jaccard": oracle.OP13,
    }
