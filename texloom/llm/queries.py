"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm import mixing, neighbours, packing, pages, permutations, pii, quality_rules, repair, set_join, sharding
from texloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; every machine of the cluster has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = repair.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return repair.read_token_files(blocks)


def op3_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_sets(table(spark, sf_dir, "documents"))


def op7_exponential_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbours.score(docs, neighbours.fit(docs, table(spark, sf_dir, "labels")))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = permutations.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_paths": op1_host_paths,
    "op2_repair_files": op2_repair_files,
    "op3_semi_markov": op3_semi_markov,
    "op4_histogram_sort": op4_histogram_sort,
    "op5_cost_packing": op5_cost_packing,
    "op6_set_relations": op6_set_relations,
    "op7_exponential_mix": op7_exponential_mix,
    "op8_nearest_votes": op8_nearest_votes,
    "op9_permutation_index": op9_permutation_index,
    "op10_decision_lists": op10_decision_lists,
}
ORACLE_SQL: dict[str, str] = {
    "op6_set_relations": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.d)
SELECT r.d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
""",
}
