"""A report of processed rows as an HTML page: a summary, and what went in beside what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a report shows at most.
SHOWN = 200


def escape(text: Column) -> Column:
    """Text that may stand in a page or an attribute."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#x27")):
        out = F.replace(out, F.lit(sign), F.lit(f"&{name};"))
    return out


def row_html(before: Column, after: Column, facts: dict[str, Column]) -> Column:
    """One row: its facts above, the raw text on the left, the fragment on the right."""
    head = F.concat_ws(" · ", *[F.concat(F.lit(f"{name}: "), F.coalesce(escape(value), F.lit(""))) for name, value in facts.items()])
    return F.concat(F.lit("<section><h2>"), head, F.lit("</h2><div class='two'><pre>"), escape(before), F.lit("</pre><div>"), F.coalesce(after, F.lit("")), F.lit("</div></div></section>"))


def summary_html(rows: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """The header: how many rows, and how many of them have each hit, with shares; one row (page)."""
    share = lambda hit: F.format_string("%d (%.1f%%)", F.count_if(hit), 100 * F.count_if(hit) / F.greatest(F.count("*"), F.lit(1)))
    parts = [F.concat(F.lit("rows: "), F.count("*").cast("string")), *[F.concat(F.lit(f"{name}: "), share(hit)) for name, hit in hits.items()]]
    return rows.agg(F.concat(F.lit("<header>"), F.concat_ws(" · ", *parts), F.lit("</header>")).alias("page"))


def report(rows: DataFrame, key: str, before: Column, after: Column, facts: dict[str, Column], hits: dict[str, Column], shown: int = SHOWN) -> DataFrame:
    """(place, page): the summary of all rows, then the first ``shown`` by key. The limit is the report's size, and the sort a top-n."""
    top = rows.select(F.col(key).alias("place"), row_html(before, after, facts).alias("page")).orderBy("place").limit(shown)
    return summary_html(rows, hits).select(F.lit(None).cast("bigint").alias("place"), "page").unionByName(top.select(F.col("place").cast("bigint").alias("place"), "page"))


def write(pages: DataFrame, path: str, title: str) -> None:
    """One text file in the folder ``path``; its size is bounded by the report's."""
    first, last = f"<!doctype html><meta charset='utf-8'><title>{title}</title><style>.two{{display:flex}}.two>*{{flex:1;overflow:auto}}</style>", "</html>"
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(-(2**63))).alias("place"), "page")))
    body = pages.agg(F.array_join(F.transform(parts, lambda p: p["page"]), "\n").alias("body"))
    body.select(F.concat(F.lit(first), F.lit("\n"), "body", F.lit("\n" + last)).alias("value")).write.mode("overwrite").text(path)
