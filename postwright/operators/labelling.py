"""Labelling store: candidate selection by quota, review updates, counts, splits, training export, quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.operators.sync import ranked_sample
from postwright.sources.shared import stage


def seeded_order(key: Column, seed: str) -> Column:
    """A reproducible random order: md5 of key and seed."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))


def map_categories(rows: DataFrame, mapping: DataFrame, how: str = "left") -> DataFrame:
    """Adds category_id by case-insensitive equality of the source's label."""
    m = mapping.select(F.lower("original_category").alias("__label"), "category_id")
    return rows.join(m, F.lower(rows["category"]) == F.col("__label"), how).drop("__label")


def quota_fill(candidates: DataFrame, existing: DataFrame, limit: int, key: str, seed: str, mapped_percent: int = 80, recheck: Column | None = None) -> DataFrame:
    """New rows to label: each category is filled to ``limit``, at most ``mapped_percent`` of the need from the mapping, the rest from the heuristic.

    ``candidates``: key, ``mapped`` and ``heuristic`` categories (or null); ``existing``: key
    and category_id of rows labelled already, which are not taken again. ``recheck``
    says which mapped labels are ambiguous: they count only where the heuristic agrees.
    Two passes over one staged table; in each a bounded number of rows per
    category is ranked, and Spark cuts each task's rows to that number before the shuffle.
    """
    have = existing.groupBy("category_id").agg(F.count("*").alias("have"))
    open_ = stage(candidates.join(existing.select(key), key, "left_anti").withColumn("__order", seeded_order(F.col(key), seed)), "quota")
    need = F.greatest(F.lit(limit) - F.coalesce("have", F.lit(0)), F.lit(0))

    def take(rows: DataFrame, share: Column, name: str) -> DataFrame:
        # no pass takes more than the limit, which is a constant that the ranking knows beforehand
        ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("category_id").orderBy("__order", key))).filter(F.col("__rank") <= limit)
        return ranked.join(have, "category_id", "left").filter(F.col("__rank") <= share).select(key, "category_id", F.lit(name).alias("pass"))

    sure = F.lit(True) if recheck is None else ~recheck | F.col("mapped").eqNullSafe(F.col("heuristic"))
    mapped = open_.filter(F.col("mapped").isNotNull() & sure).select(key, F.col("mapped").alias("category_id"), "__order")
    first = stage(take(mapped, F.floor(need * mapped_percent / 100), "map"), "quota-map")
    have = have.join(first.groupBy("category_id").agg(F.count("*").alias("taken")), "category_id", "full").select("category_id", (F.coalesce("have", F.lit(0)) + F.coalesce("taken", F.lit(0))).alias("have"))
    rest = open_.filter("heuristic IS NOT NULL").select(key, F.col("heuristic").alias("category_id"), "__order").join(first.select(key), key, "left_anti")
    return first.unionByName(take(rest, need, "heuristic"))


def review_counts(categories: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per category, also empty ones: rows and reviewed rows."""
    counts = labelled.groupBy("category_id").agg(F.count("*").alias("total"), F.count_if("verified").alias("reviewed"))
    joined = categories.join(counts, categories.id == counts.category_id, "left")
    return joined.select("id", "title", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("reviewed", F.lit(0)).alias("reviewed"))


def relabel(labelled: DataFrame, changes: DataFrame, categories: DataFrame) -> DataFrame:
    """Applies (id, category_id) changes whose category exists."""
    valid = changes.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi").select(F.col("id").alias("__id"), F.col("category_id").alias("__category"))
    joined = labelled.join(valid, labelled.id == F.col("__id"), "left")
    return joined.select(*[(F.coalesce("__category", "category_id") if c == "category_id" else labelled[c]).alias(c) for c in labelled.columns])


def toggle(labelled: DataFrame, ids: DataFrame) -> DataFrame:
    """Flips ``verified`` of the rows in ``ids(id)``."""
    marked = labelled.join(ids.select("id").distinct().withColumn("__flip", F.lit(True)), "id", "left")
    return marked.select(*[(F.col("verified") != F.coalesce("__flip", F.lit(False))).alias(c) if c == "verified" else F.col(c) for c in labelled.columns])


def would_change(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every stored row: key, ``changed_*`` for each column of ``found`` (nulls are equal), and ``would_update``: whether any differs. Rows that ``found`` lacks don't change."""
    columns = [c for c in found.columns if c != key]
    new = found.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.join(new, stored[key] == F.col("__key"), "left")
    differs = [(F.col("__key").isNotNull() & ~stored[c].eqNullSafe(F.col(f"__{c}"))).alias(f"changed_{c}") for c in columns]
    return joined.select(stored[key], *differs).withColumn("would_update", F.greatest(*[F.col(f"changed_{c}") for c in columns], F.lit(False)))


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: str) -> DataFrame:
    """Adds ``validation``: that share of each class, rounded, by a seeded order."""
    sizes = rows.groupBy(label).agg(F.round(F.count("*") * share).cast("long").alias("__n"))
    picked = ranked_sample(rows.select(key, label).join(sizes, label), seeded_order(F.col(key), seed), F.col("__n"), [label])
    return rows.join(picked.select(key, F.lit(True).alias("__v")), key, "left").withColumn("validation", F.coalesce("__v", F.lit(False))).drop("__v")


def training_rows(labelled: DataFrame) -> DataFrame:
    """Training export: title, label, plain description and category, null-free, in category order."""
    plain = F.trim(F.regexp_replace(F.coalesce("description_clean", F.lit("")), "<[^>]*>", " "))
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = labelled.select("category_id", "id", blank(F.coalesce("title_clean", "title")).alias("title"), blank(F.col("original_category")).alias("original_category"), plain.alias("description_plaintext"))
    return rows.orderBy("category_id", "id").select("title", "original_category", "description_plaintext", "category_id")


def write_training_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def read_training_csv(spark, path: str) -> DataFrame:
    schema = "title string, original_category string, description_plaintext string, category_id bigint"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def classification_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, F1 and support, from one grouped count of (label, prediction)."""
    cells = rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_pred = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    joined = by_label.join(by_pred, "label", "full")
    hits, support, claimed = (F.coalesce(c, F.lit(0)).cast("double") for c in ("hits", "support", "claimed"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(hits, claimed), ratio(hits, support)
    return joined.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), support.cast("long").alias("support"))


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy-free summary: macro and weighted averages of a classification report."""
    return report.agg(F.sum("support").alias("total"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def hit_rates(rows: DataFrame, by: list[str], hits: dict[str, Column], means: dict[str, Column] | None = None) -> DataFrame:
    """Rows, how many and what share of them have each hit, and means of measures (such as a latency)."""
    aggs = [F.count("*").alias("n_rows")]
    for name, hit in hits.items():
        aggs += [F.count_if(hit).alias(f"n_{name}"), F.round(F.count_if(hit) / F.count("*"), 6).alias(f"share_{name}")]
    aggs += [F.round(F.avg(measure), 6).alias(f"mean_{name}") for name, measure in (means or {}).items()]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows, and the share whose prediction is the label; null labels and predictions are never right."""
    return rows.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(label) == F.col(predicted), F.lit(False)).cast("double")).alias("accuracy"))


def verified_only(rows: DataFrame, enabled: bool = True, category: int | None = None) -> DataFrame:
    """Reviewed rows, if the filter is enabled, of one category, if one is given."""
    rows = rows.filter("verified") if enabled else rows
    return rows if category is None else rows.filter(F.col("category_id") == category)


def rerank(probabilities: Column, floors: dict[int, float]) -> Column:
    """(category id, confidence) of class probabilities: a top class below its floor gives way to the second best, once."""
    top = F.array_max(probabilities)
    place = F.array_position(probabilities, top).cast("int")
    floor = F.try_element_at(F.create_map(*[F.lit(x) for pair in floors.items() for x in pair]), place)
    others = F.transform(probabilities, lambda p, i: F.when(i + 1 == place, F.lit(0.0)).otherwise(p))
    second = F.array_max(others)
    other = F.array_position(others, second).cast("int")
    low = floor.isNotNull() & (top < floor)
    return F.struct(F.when(low, other).otherwise(place).alias("category_id"), F.when(low, second).otherwise(top).alias("confidence"))
