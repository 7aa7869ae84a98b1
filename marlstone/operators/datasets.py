"""Splits, samples and caps of datasets, and checks that they leak nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.runtime import staged

#: Buckets of ten that go to the test and the validation split.
TEST, VALIDATION = 1, 1


def bucket(key: Column, salt: str, buckets: int = 10) -> Column:
    """A stable bucket of a key from its SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), key.cast("string")), 256), 1, 12), 16, 10).cast("long") % buckets


def split_of(key: Column, salt: str = "split") -> Column:
    """test for a tenth, validation for a tenth, train for the rest."""
    b = bucket(key, salt)
    return F.when(b < TEST, "test").when(b < TEST + VALIDATION, "validation").otherwise("train")


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the least node reachable over edges (a, b), strings.

    Labels are lowered by neighbours and halved by their own label's label; each
    round is written to the shared folder. Null ends make no edge; a loop makes a
    component of one.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = staged(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        lower = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(lower, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        labels_next = staged(step.join(far, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component")), "labels")
        settled = not labels_next.where(F.col("old") != F.col("component")).limit(1).count()
        labels = labels_next.select("node", "component")
        if settled:
            return labels
    raise RuntimeError("components did not settle")


def isolated_splits(rows: DataFrame, row: str, groups: list[str], salt: str = "split") -> DataFrame:
    """row, component, split: rows that share a value of any group column, directly or through others, share a split.

    Null group values bind nothing; a row with none is a component of its own.
    """
    tagged = [F.when(F.col(g).isNotNull(), F.concat(F.lit(f"{g}="), F.col(g).cast("string"))) for g in groups]
    nodes = rows.select(F.col(row).alias("row"), F.concat(F.lit("#"), F.col(row).cast("string")).alias("own"), F.array_compact(F.array(*tagged)).alias("tags"))
    first = F.get("tags", F.lit(0))
    edges = nodes.select(first.alias("a"), F.explode("tags").alias("b")).where(F.col("a").isNotNull()).distinct()
    parts = connected(edges)
    out = nodes.select("row", "own", first.alias("node")).join(parts, "node", "left").select("row", F.coalesce("component", "own").alias("component"))
    return out.withColumn("split", split_of(F.col("component"), salt))


def leaks(rows: DataFrame, split: str, groups: list[str]) -> DataFrame:
    """dimension, value, splits: group values found in more than one split."""
    out = None
    for g in groups:
        one = rows.where(F.col(g).isNotNull()).groupBy(F.col(g).cast("string").alias("value")).agg(F.countDistinct(split).alias("splits")).where(F.col("splits") > 1)
        one = one.select(F.lit(g).alias("dimension"), "value", "splits")
        out = one if out is None else out.unionByName(one)
    return out


def stratified_sample(rows: DataFrame, row: str, stratum: str, size: int, salt: str = "sample") -> DataFrame:
    """About ``size`` rows, each stratum in proportion (rounded half up), those first in a hash order."""
    total = F.broadcast(rows.agg(F.count("*").alias("_total")))
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_n")).crossJoin(total).withColumn("_take", F.floor(F.col("_n") * size / F.col("_total") + 0.5)).drop("_n", "_total")
    order = F.sha2(F.concat(F.lit(salt), F.col(row).cast("string")), 256)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, row))).where(F.col("_r") <= size)
    same = ranked[stratum].eqNullSafe(counts[stratum])
    return ranked.join(F.broadcast(counts) if counts.limit(10_001).count() <= 10_000 else counts, same).where(F.col("_r") <= F.col("_take")).select(*[ranked[c] for c in rows.columns])


def hash_sample(rows: DataFrame, row: str, n: int, salt: str = "sample") -> DataFrame:
    """The ``n`` rows first in a hash order."""
    return rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col(row).cast("string")), 256), row).limit(n)


def round_robin(rows: DataFrame, row: str, stratum: str, n: int, salt: str = "pick") -> DataFrame:
    """``n`` rows taken in rounds, one of each stratum a round, larger strata first within a round."""
    w = Window.partitionBy(stratum)
    order = F.sha2(F.concat(F.lit(salt), F.col(row).cast("string")), 256)
    ranked = rows.withColumn("round", F.row_number().over(w.orderBy(order, row)))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    kept = ranked.where(F.col("round") <= n)
    both = kept.join(sizes, kept[stratum].eqNullSafe(sizes[stratum])).select(*[kept[c] for c in kept.columns], "_size")
    return both.orderBy("round", F.col("_size").desc(), stratum).limit(n).drop("_size")


def first_of_kind(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Adds duplicate: whether an earlier row has the same keys; the earliest by a total order is the one kept. Null keys are alike.

    Only the first rows' places in the order are joined back, so no key is a task of its own.
    """
    names = [f"_o{i}" for i in range(len(order))]
    marked = rows.withColumns(dict(zip(names, order, strict=True)))
    firsts = marked.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*names)).alias("_f")).select(*[F.col("_f")[n].alias(n) for n in names], F.lit(False).alias("duplicate"))
    return marked.join(firsts, names, "left").drop(*names).withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))


def capped_by_level(rows: DataFrame, level: str, preferred: Column, tie: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each level, preferred ones first, then by ``tie``."""
    w = Window.partitionBy(level).orderBy(preferred.desc(), tie)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def missing_labels(rows: DataFrame, groups: list[str], label: str, wanted: list[int]) -> DataFrame:
    """The groups' values and missing: the wanted labels that a group has no row of, where there are any."""
    has = rows.groupBy(*groups).agg(F.collect_set(F.when(F.col(label).isin(wanted), F.col(label))).alias("_has"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.col("_has")))
    return has.select(*groups, missing.alias("missing")).where(F.size("missing") > 0)


def truth_by_priority(sources: list[DataFrame], keys: list[str], label: str) -> DataFrame:
    """keys, label: of several label sets, earlier ones win; within one, the higher label."""
    every = None
    for i, s in enumerate(sources):
        one = s.select(*keys, F.col(label).alias("label"), F.lit(-i).alias("_p"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*keys).agg(F.max(F.struct("_p", "label"))["label"].alias("label"))


def frozen(rows: DataFrame, reasons: dict[str, Column], keys: list[Column], order: list[Column]) -> DataFrame:
    """Adds reasons, an array: why a row can't be held out. A row with the keys of an earlier acceptable one is DUPLICATE;
    rows with another reason don't make later ones duplicates. An empty array means the row is in."""
    why = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in reasons.items()]))
    marked = rows.withColumn("reasons", why).withColumn("_ok", F.size("reasons") == 0)
    told = first_of_kind(marked, [*keys, F.col("_ok")], order)
    return told.withColumn("reasons", F.when(F.col("_ok") & F.col("duplicate"), F.array(F.lit("DUPLICATE"))).otherwise(F.col("reasons"))).drop("_ok", "duplicate")
