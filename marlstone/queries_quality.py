"""Queries on ranking quality and dataset splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.codes import denoted_code, denoted_sql, family_key
from marlstone.operators import datasets, events, quality
from marlstone.queries_text import SQL as TEXT_SQL
from marlstone.queries_text import vector_nearest
from marlstone.runtime import BROADCAST_ROWS, within
from marlstone.tables import table


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return vector_nearest(spark, d).select("query", F.col("doc").alias("item"), "rank", "score")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Label 3 for the same cluster, 2 for its neighbours, 0 for an even distance, else 1: for each stated query, all rows."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("l"))
    asked = table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("label").alias("q"), F.sequence(F.lit(0), F.lit(9)).alias("of"))
    # every label meets every query through the ten labels there are
    few = asked.select("query", "q", F.explode("of").alias("l"))
    pairs = (F.broadcast(few) if within(few, BROADCAST_ROWS) else few).join(rows, "l")
    gap = F.abs(F.col("l") - F.col("q"))
    return pairs.select("query", "item", F.when(gap == 0, 3).when(gap == 1, 2).when(gap % 2 == 0, 0).otherwise(1).alias("label"))


def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.ranking_metrics(_ranked(spark, d), _truth(spark, d))


def quality_weighted(spark: SparkSession, d: str) -> DataFrame:
    names = _truth(spark, d).withColumn("label", F.element_at(F.array(*[F.lit(x) for x in ("NONE", "WEAK", "VALID", "DIRECT")]), F.col("label") + 1))
    return quality.weighted_label(_ranked(spark, d), names, {"DIRECT": 1.0, "VALID": 0.75, "WEAK": 0.3, "UNCERTAIN": 0.5})


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "v4_2_train_pairs_a").select("pairid", "label", "split", "source", "query_id", "queryfamily", F.length("query").alias("size"), denoted_code(F.col("companycode")).alias("code"))


def quality_inversions(spark: SparkSession, d: str) -> DataFrame:
    return quality.inversions(_pairs(spark, d), "source", "label", "size", 3).withColumnRenamed("query", "source")


def quality_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return quality.rank_correlation(_pairs(spark, d), "source", "label", "size", "pairid").withColumnRenamed("group", "source")


def quality_run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The ranking against itself without every seventh row."""
    before = _ranked(spark, d)
    kept = before.where(F.col("item") % 7 != 0)
    after = kept.withColumn("rank", F.col("rank") - F.pmod(F.col("item"), F.lit(2)).cast("int"))
    out = quality.run_comparison(before, after)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("entered", "left_")})


def quality_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d)
    return quality.transitions(rows, rows.withColumn("label", F.least(F.lit(3), F.col("label") + F.pmod("pairid", F.lit(3)).cast("int"))), "pairid", "label")


def quality_variance_share(spark: SparkSession, d: str) -> DataFrame:
    return quality.variance_share(_pairs(spark, d), "source", "label")


def quality_wrongly_above(spark: SparkSession, d: str) -> DataFrame:
    """Shown items of an odd id above the first relevant one, the query itself aside."""
    rows = _ranked(spark, d).where(F.col("item") != F.col("query")).join(_truth(spark, d), ["query", "item"]).withColumn("odd", F.col("item") % 2 == 1)
    return quality.wrongly_above(rows, "odd", "label", 3).select("query", "item", "rank")


def quality_grade_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.grade_summary(_pairs(spark, d), "source", "label", "pairid", 500).withColumnRenamed("group", "source")


def quality_binary_dcg(spark: SparkSession, d: str) -> DataFrame:
    return quality.binary_dcg(_ranked(spark, d), _truth(spark, d), 10, 3)


def quality_cohort_margin(spark: SparkSession, d: str) -> DataFrame:
    """Grades of the pairs with long queries against those with short ones, by source."""
    rows = _pairs(spark, d).withColumn("mine", F.col("size") > 16).withColumn("foil", F.col("size") < 10)
    return quality.cohort_margin(rows, "source", "mine", "foil", "label")


def quality_case_summary(spark: SparkSession, d: str) -> DataFrame:
    truth = _truth(spark, d)
    return quality.case_summary(_ranked(spark, d), truth.where("label = 3"), truth.where("label = 0"))


def quality_list_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "companies").withColumn("products", F.col("mainproducts.name"))
    return quality.list_sizes(rows, ["concepts", "products"])


def quality_offenders(spark: SparkSession, d: str) -> DataFrame:
    """Companies shown within the first twenty for many queries at a poor grade."""
    rows = _pairs(spark, d).where(F.col("code").isNotNull()).withColumn("place", F.pmod("pairid", F.lit(40)).cast("int") + 1)
    return events.offenders_by_grade(rows, "code", "query_id", "label", "place", 3, 2.0)


def quality_irrelevant(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).where(F.col("code").isNotNull()).withColumn("place", F.pmod("pairid", F.lit(40)).cast("int") + 1)
    return events.plainly_irrelevant(rows, "code", "queryfamily", "label", "place", "size")


def dataset_missing_labels(spark: SparkSession, d: str) -> DataFrame:
    """Splits and sources that lack rows of label 0 or 3."""
    rows = _pairs(spark, d).withColumn("assigned", datasets.split_of(F.col("pairid"))).withColumn("family", family_key(F.col("queryfamily"))).where(F.col("family").isNotNull())
    return datasets.missing_labels(rows, ["assigned", "family"], "label", [0, 3]).withColumn("missing", F.array_join("missing", ","))


def dataset_frozen(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs that could be held out, and why others can't."""
    rows = table(spark, d, "v4_2_train_pairs_a").select("pairid", "query", "label", "evidence", "split")
    out = datasets.frozen(
        rows, {"NO_LABEL": F.col("label").isNull(), "NO_EVIDENCE": F.col("evidence").isNull(), "NO_QUERY": F.col("query").isNull() | (F.trim("query") == "")}, [F.lower(F.trim("query")), F.col("split")], [F.col("pairid")]
    )
    return out.select("pairid", F.array_join("reasons", ",").alias("reasons"))


def dataset_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("pairid", datasets.split_of(F.col("pairid")).alias("assigned"))


def dataset_isolated_splits(spark: SparkSession, d: str) -> DataFrame:
    """Facts that share a company or a digest, directly or not, get one split."""
    rows = table(spark, d, "facts").select("ingestid", denoted_code(F.col("companycode")).alias("code"), "artifactsha256")
    return datasets.isolated_splits(rows, "ingestid", ["code", "artifactsha256"])


def dataset_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("assigned", datasets.split_of(F.col("pairid")))
    return datasets.leaks(rows, "assigned", ["code", "query_id"])


def dataset_stratified(spark: SparkSession, d: str) -> DataFrame:
    return datasets.stratified_sample(_pairs(spark, d).select("pairid", "source"), "pairid", "source", 500)


def dataset_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return datasets.hash_sample(_pairs(spark, d).select("pairid"), "pairid", 200)


def dataset_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return datasets.round_robin(_pairs(spark, d).select("pairid", "source"), "pairid", "source", 60)


def dataset_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "v4_2_train_pairs_a").select("pairid", "query", "companycode")
    return datasets.first_of_kind(rows, [F.lower(F.trim("query")), F.col("companycode")], [F.col("pairid")]).select("pairid", "duplicate")


def dataset_capped_levels(spark: SparkSession, d: str) -> DataFrame:
    return datasets.capped_by_level(_pairs(spark, d).select("pairid", "label", "size"), "label", F.col("size") > 12, "pairid", 100).select("pairid", "label")


def dataset_truth(spark: SparkSession, d: str) -> DataFrame:
    """One label a query and company: the benchmark's first, then the training pairs'."""
    b = table(spark, d, "stage3_semiconductor_benchmark")
    three = b.select("query_id", F.explode("relevant3.code").alias("code"), F.lit(3).alias("label"))
    two = b.select("query_id", F.explode("relevant2.code").alias("code"), F.lit(2).alias("label"))
    pairs = _pairs(spark, d).select("query_id", "code", "label").where(F.col("label").isNotNull())
    return datasets.truth_by_priority([three, two, pairs], ["query_id", "code"], "label")


def dataset_family_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Rows and mean label by family and source, with subtotals."""
    rows = _pairs(spark, d).select(family_key(F.col("queryfamily")).alias("family"), "source", "label").where(F.col("family").isNotNull() & F.col("source").isNotNull())
    return rows.rollup("source", "family").agg(F.count("*").alias("rows"), F.round(F.avg("label"), 6).alias("mean_label"), F.grouping_id().alias("level"))


QUERIES = {
    f.__name__: f
    for f in (
        quality_metrics, quality_weighted, quality_inversions, quality_rank_correlation, quality_run_comparison, quality_transitions, quality_variance_share, quality_wrongly_above, quality_grade_summary, dataset_frozen, dataset_hash_split, dataset_isolated_splits,
        quality_binary_dcg, quality_cohort_margin, quality_case_summary, quality_list_sizes, quality_offenders, quality_irrelevant, dataset_missing_labels, dataset_leaks, dataset_stratified, dataset_hash_sample, dataset_round_robin, dataset_duplicates, dataset_capped_levels, dataset_truth, dataset_family_rollup,
    )
}

_NEAR = f"ranked AS MATERIALIZED (SELECT query, doc AS item, rank, score FROM ({TEXT_SQL['vector_nearest']}))"
_TRUTH = "truth AS (SELECT a.vec_id AS query, b.vec_id AS item, CASE abs(a.label - b.label) WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE CASE WHEN abs(a.label - b.label) % 2 = 0 THEN 0 ELSE 1 END END AS label FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"
_P = f"p AS (SELECT pairid, label, split, source, query_id, queryfamily, length(query) AS size, {denoted_sql('companycode')} AS code FROM v4_2_train_pairs_a)"
_BUCKET = "(('0x' || substr(sha256('split:' || {k}::VARCHAR), 1, 12))::BIGINT % 10)"
_SPLIT = f"CASE WHEN {_BUCKET} < 1 THEN 'test' WHEN {_BUCKET} < 2 THEN 'validation' ELSE 'train' END"
SQL = {
    "quality_binary_dcg": f"WITH {_NEAR}, {_TRUTH} SELECT query, round(sum(CASE WHEN label >= 3 THEN 1.0::DOUBLE ELSE 0 END / log2(rank + 1)), 6) AS dcg FROM ranked LEFT JOIN truth USING (query, item) WHERE rank <= 10 GROUP BY query",
    "quality_cohort_margin": f"WITH {_P}, m AS (SELECT source, max(label) FILTER (size > 16) AS mine_best, round(avg(label) FILTER (size > 16), 6) AS mine_mean, max(label) FILTER (size < 10) AS foil_best, round(avg(label) FILTER (size < 10), 6) AS foil_mean FROM p GROUP BY source) SELECT *, round(mine_mean - foil_mean, 6) AS margin FROM m",
    "quality_case_summary": f"WITH {_NEAR}, {_TRUTH} SELECT query, " + ", ".join(f"coalesce(bool_or(label = 3 AND rank <= {k}), false) AS hit_{k}" for k in (1, 5, 10)) + ", coalesce(bool_or(label = 0 AND (rank <= 10 OR score >= 0.6)), false) AS intruded FROM ranked LEFT JOIN truth USING (query, item) GROUP BY query",
    "quality_list_sizes": "WITH l AS (SELECT 'concepts' AS list, coalesce(concepts, []) AS x FROM companies UNION ALL SELECT 'products', list_transform(coalesce(mainproducts, []), lambda s: s.name) FROM companies) SELECT list, count(*) FILTER (len(x) > 0) AS rows, sum(len(x)) AS members, max(len(list_distinct(x)) + CASE WHEN list_contains(list_transform(x, lambda v: v IS NULL), true) THEN 1 ELSE 0 END) AS most, round(avg(len(list_distinct(x)) + CASE WHEN list_contains(list_transform(x, lambda v: v IS NULL), true) THEN 1 ELSE 0 END) FILTER (len(x) > 0), 6) AS mean FROM l GROUP BY list",
    "quality_offenders": f"WITH {_P} SELECT code, count(DISTINCT query_id) AS queries, round(avg(label), 6) AS mean_grade FROM p WHERE code IS NOT NULL AND pairid % 40 + 1 <= 20 AND label IS NOT NULL GROUP BY code HAVING count(DISTINCT query_id) >= 3 AND round(avg(label), 6) < 2",
    "quality_irrelevant": f"WITH {_P} SELECT code, count(*) AS n, round(avg(pairid % 40 + 1), 6) AS mean_rank, round(avg(size), 6) AS mean_score, count(DISTINCT queryfamily) AS families, count(*) FILTER (label = 0) AS l0, count(*) FILTER (label = 1) AS l1 FROM p WHERE code IS NOT NULL AND label <= 1 GROUP BY code",
    "dataset_missing_labels": f"WITH {_P}, s AS (SELECT {_SPLIT.format(k='pairid')} AS assigned, regexp_replace(upper(queryfamily), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS family, label FROM p WHERE queryfamily IS NOT NULL), g AS (SELECT assigned, family, concat_ws(',', CASE WHEN NOT coalesce(bool_or(label = 0), false) THEN '0' END, CASE WHEN NOT coalesce(bool_or(label = 3), false) THEN '3' END) AS missing FROM s GROUP BY ALL) SELECT * FROM g WHERE missing <> ''",
    "quality_run_comparison": f"WITH {_NEAR}, b AS (SELECT * FROM ranked), a AS (SELECT query, item, rank - (item % 2) AS rank, score FROM ranked WHERE item % 7 <> 0), x AS (SELECT query, item, rank FROM b WHERE rank <= 10), y AS (SELECT query, item, rank FROM a WHERE rank <= 10), "
    "n AS (SELECT query, count(*) AS n, arg_min(item, (rank, item)) AS top FROM x GROUP BY query), m AS (SELECT query, arg_min(item, (rank, item)) AS top FROM y GROUP BY query), "
    "f AS (SELECT coalesce(x.query, y.query) AS query, x.item AS xi, y.item AS yi FROM x FULL JOIN y USING (query, item)), "
    "g AS (SELECT query, count(*) FILTER (xi IS NOT NULL AND yi IS NOT NULL) AS shared, coalesce(string_agg(yi::VARCHAR, ',' ORDER BY yi) FILTER (xi IS NULL), '') AS entered, coalesce(string_agg(xi::VARCHAR, ',' ORDER BY xi) FILTER (yi IS NULL), '') AS left_ FROM f GROUP BY query), "
    "s AS (SELECT query, round(avg(abs(a.rank - b.rank)), 6) AS mean_rank_shift, round(avg(abs(a.score - b.score)), 6) AS mean_score_shift FROM b JOIN a USING (query, item) GROUP BY query) "
    "SELECT query, round(shared / greatest(1, least(coalesce(n, 0), 10)), 6) AS overlap, entered, left_, n.top IS DISTINCT FROM m.top AS top_changed, mean_rank_shift, mean_score_shift FROM g LEFT JOIN n USING (query) LEFT JOIN m USING (query) LEFT JOIN s USING (query)",
    "dataset_isolated_splits": f"WITH RECURSIVE f AS (SELECT ingestid, {denoted_sql('companycode')} AS code, artifactsha256 FROM facts), t AS (SELECT ingestid, 'code=' || code AS tag FROM f WHERE code IS NOT NULL UNION ALL SELECT ingestid, 'artifactsha256=' || artifactsha256 FROM f WHERE artifactsha256 IS NOT NULL), "
    "e AS MATERIALIZED (SELECT DISTINCT a.tag AS x, b.tag AS y FROM t a JOIN t b USING (ingestid)), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS component FROM r GROUP BY x), "
    f"o AS (SELECT f.ingestid, coalesce(min(c.component), '#' || f.ingestid::VARCHAR) AS component FROM f LEFT JOIN t USING (ingestid) LEFT JOIN c ON c.x = t.tag GROUP BY f.ingestid) SELECT ingestid AS row, component, {_SPLIT.format(k='component')} AS split FROM o",
    "quality_metrics": f"""WITH {_NEAR}, {_TRUTH}, s AS (SELECT r.query, sum(coalesce(2.0 ** label - 1, 0) / log2(rank + 1)) AS dcg, count(*) FILTER (label >= 2) AS hits, min(rank) FILTER (label >= 2) AS first_relevant, count(*) FILTER (label = 0) AS bad FROM ranked r LEFT JOIN truth t ON t.query = r.query AND t.item = r.item WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query, sum((2.0 ** label - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY label DESC, item) AS r FROM truth) WHERE r <= 10 GROUP BY 1), w AS (SELECT query, count(*) FILTER (label >= 2) AS wanted FROM truth GROUP BY 1)
SELECT query, round(dcg, 6) AS dcg, round(dcg / ideal, 6) AS ndcg, round(hits / 10, 6) AS precision, round(hits / nullif(wanted, 0), 6) AS recall, first_relevant, round(coalesce(1 / first_relevant, 0), 6) AS reciprocal_rank, bad FROM w JOIN i USING (query) JOIN s USING (query)""",
    "quality_weighted": f"WITH {_NEAR}, {_TRUTH} SELECT r.query, count(*) AS judged, floor(avg(CASE label WHEN 3 THEN 1.0 WHEN 2 THEN 0.75 WHEN 1 THEN 0.3 ELSE 0.0 END::DOUBLE) * 10000 + 0.5) / 10000 AS mean FROM ranked r JOIN truth t ON t.query = r.query AND t.item = r.item WHERE rank <= 10 GROUP BY 1",
    "quality_transitions": f"WITH {_P} SELECT label AS old, least(3, label + pairid % 3) AS new, count(*) AS n FROM p GROUP BY ALL",
    "quality_variance_share": f"WITH {_P} SELECT round((SELECT var_pop(m) FROM (SELECT avg(label) AS m FROM p WHERE label IS NOT NULL GROUP BY source)) / (SELECT var_pop(label) FROM p), 6) AS share",
    "quality_inversions": f"WITH {_P}, k AS (SELECT source, label, size, count(*) AS n FROM p WHERE label IS NOT NULL AND size IS NOT NULL GROUP BY ALL) SELECT source, coalesce(sum(a.n * b.n), 0)::BIGINT AS pairs, coalesce(sum(a.n * b.n) FILTER (b.size > a.size), 0)::BIGINT AS inverted, round(inverted / nullif(pairs, 0), 6) AS rate FROM (SELECT DISTINCT source FROM k) LEFT JOIN (SELECT * FROM k WHERE label = 3) a USING (source) LEFT JOIN (SELECT * FROM k WHERE label < 3) b USING (source) GROUP BY source",
    "quality_rank_correlation": f"WITH {_P}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY label, pairid)::DOUBLE AS x, row_number() OVER (PARTITION BY source ORDER BY size, pairid)::DOUBLE AS y FROM p WHERE label IS NOT NULL AND size IS NOT NULL) SELECT source, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1",
    "quality_wrongly_above": f"WITH {_NEAR}, {_TRUTH}, j AS (SELECT r.*, label, min(rank) FILTER (label >= 3) OVER (PARTITION BY r.query) AS f FROM ranked r JOIN truth t ON t.query = r.query AND t.item = r.item WHERE r.item <> r.query) SELECT query, item, rank FROM j WHERE item % 2 = 1 AND (f IS NULL OR rank < f)",
    "quality_grade_summary": f"WITH {_P}, g AS (SELECT source, count(*) AS rows, list_sort(list(label)) AS v, round(avg(label), 6) AS mean, round(avg((label >= 1.5)::INT), 6) AS from_1_5, round(avg((label >= 2)::INT), 6) AS from_2, round(avg(label) FILTER (pairid <= 500), 6) AS shown_mean FROM p WHERE label IS NOT NULL GROUP BY source) SELECT source, rows, mean, from_1_5, from_2, shown_mean, v[1 + least(rows - 1, floor(rows * 0.5::DOUBLE))::INT]::DOUBLE AS median, v[1 + least(rows - 1, floor(rows * 0.9::DOUBLE))::INT]::DOUBLE AS p90, round(shown_mean - mean, 6) AS margin FROM g",
    "dataset_frozen": "WITH r AS (SELECT pairid, lower(trim(query)) AS q, split, concat_ws(',', CASE WHEN label IS NULL THEN 'NO_LABEL' END, CASE WHEN evidence IS NULL THEN 'NO_EVIDENCE' END, CASE WHEN query IS NULL OR trim(query) = '' THEN 'NO_QUERY' END) AS w FROM v4_2_train_pairs_a) SELECT pairid, CASE WHEN w = '' AND row_number() OVER (PARTITION BY q, split, w = '' ORDER BY pairid) > 1 THEN 'DUPLICATE' ELSE w END AS reasons FROM r",
    "dataset_hash_split": f"SELECT pairid, {_SPLIT.format(k='pairid')} AS assigned FROM v4_2_train_pairs_a",
    "dataset_leaks": f"WITH {_P}, s AS (SELECT *, {_SPLIT.format(k='pairid')} AS assigned FROM p) SELECT 'code' AS dimension, code AS value, count(DISTINCT assigned) AS splits FROM s WHERE code IS NOT NULL GROUP BY code HAVING count(DISTINCT assigned) > 1 UNION ALL SELECT 'query_id', query_id, count(DISTINCT assigned) FROM s WHERE query_id IS NOT NULL GROUP BY query_id HAVING count(DISTINCT assigned) > 1",
    "dataset_stratified": "SELECT pairid, source FROM (SELECT pairid, source, row_number() OVER (PARTITION BY source ORDER BY sha256('sample' || pairid::VARCHAR), pairid) AS r, floor(count(*) OVER (PARTITION BY source) * 500 / count(*) OVER () + 0.5) AS take FROM v4_2_train_pairs_a) WHERE r <= take",
    "dataset_hash_sample": "SELECT pairid FROM v4_2_train_pairs_a ORDER BY sha256('sample' || pairid::VARCHAR), pairid LIMIT 200",
    "dataset_round_robin": "SELECT pairid, source, round FROM (SELECT pairid, source, row_number() OVER (PARTITION BY source ORDER BY sha256('pick' || pairid::VARCHAR), pairid) AS round, count(*) OVER (PARTITION BY source) AS size FROM v4_2_train_pairs_a) ORDER BY round, size DESC, source LIMIT 60",
    "dataset_duplicates": "SELECT pairid, row_number() OVER (PARTITION BY lower(trim(query)), companycode ORDER BY pairid) > 1 AS duplicate FROM v4_2_train_pairs_a",
    "dataset_capped_levels": "SELECT pairid, label FROM (SELECT pairid, label, row_number() OVER (PARTITION BY label ORDER BY coalesce(length(query) > 12, false) DESC, pairid) AS r FROM v4_2_train_pairs_a) WHERE r <= 100",
    "dataset_truth": f"WITH {_P}, e AS (SELECT query_id, unnest(relevant3).code AS code, 3 AS label, 0 AS pr FROM stage3_semiconductor_benchmark UNION ALL SELECT query_id, unnest(relevant2).code, 2, -1 FROM stage3_semiconductor_benchmark UNION ALL SELECT query_id, code, label, -2 FROM p WHERE label IS NOT NULL) SELECT query_id, code, arg_max(label, (pr, label)) AS label FROM e GROUP BY ALL",
    "dataset_family_rollup": "WITH f AS (SELECT source, regexp_replace(upper(queryfamily), '[^\\p{L}\\p{N}]+', '', 'g') AS family, label FROM v4_2_train_pairs_a WHERE queryfamily IS NOT NULL AND source IS NOT NULL) SELECT source, family, count(*) AS rows, round(avg(label), 6) AS mean_label, grouping_id(source, family) AS level FROM f GROUP BY ROLLUP (source, family)",
}
