"""Job postings derived from the order tables, by one SQL text that both engines can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Titles and descriptions by key; {en}, {iso}, {dmy}, {opening} stand for dates of the row.
TITLES = [
    "Software Engineer - Full Time", "Cook $18.50/hr", "Vendeur (h/f)", "Permanent Reliever", "Analyst #ABC", "Hiring Now | Driver", "Data Scientist",
    "up to $90k Nurse", "Techniker m/w/d - Full-Time", "Intern - new grad", "Clerk (1234-56)", "Cashier, part time,",
]
DESCRIPTIONS = [
    ["About the role", "Application Deadline: {en}", "Send your resume to jane@acme.example"],
    ["Closing Date: {dmy}", "Write to careers@acme.example"],
    ["Unposting Date: Ongoing", "Deadline: {iso}"],
    ["Please apply online by {en}. Thank you", "For accommodation write to recruitment@acme.example"],
    ["Submit a resume by", "{en}"],
    ["Submit your application via our website by {en}"],
    ["This posting will close at 11:59 pm MST on {en}"],
    ["We are accepting applications until:", "{en}", "noreply@acme.example apply now"],
    ["Send us your resume", "by {en}"],
    ["Du {opening}", "au {iso}"],
    ["Closing date", "Friday,", "{en}"],
    ["Accepted through April 12th"],
    ["Start date: {iso}", "Questions: office@acme.example"],
    ["Nothing to see here", "contact x@y.example, x@y.example"],
    ["deadline: 22nd March 1998"],
    ["Date limite pour postuler: 2 avril 1997"],
]


def _case(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {whens} END"


def _text(parts: list[str]) -> str:
    joined = "\n".join(parts)
    out, rest = [], joined
    while rest:
        at = min((rest.find(x) for x in ("{", "\n") if x in rest), default=-1)
        if at < 0:
            out.append(f"'{rest}'")
            break
        if at:
            out.append(f"'{rest[:at]}'")
        if rest[at] == "\n":
            out.append("chr(10)")
            rest = rest[at + 1 :]
        else:
            end = rest.index("}", at)
            out.append(rest[at + 1 : end])
            rest = rest[end + 1 :]
    return " || ".join(out)


def postings_sql(spark: bool) -> str:
    """The view's SELECT, for Spark or for DuckDB."""
    if spark:
        day = "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 60 AS INT))"
        fmt = lambda d, s, _: f"date_format({d}, '{s}')"
        expires = "o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 60 AS INT))"
    else:
        day = "(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT))"
        fmt = lambda d, _, s: f"strftime({d}, '{s}')"
        expires = "o_orderdate + to_days(CAST(o_orderkey % 60 AS INT))"
    dates = {"en": fmt(day, "MMMM d, yyyy", "%B %-d, %Y"), "iso": fmt(day, "yyyy-MM-dd", "%Y-%m-%d"), "dmy": fmt(day, "dd/MM/yyyy", "%d/%m/%Y"), "opening": fmt("CAST(o_orderdate AS DATE)", "yyyy-MM-dd", "%Y-%m-%d")}
    text = _case("o_orderkey", [_text(d) for d in DESCRIPTIONS])
    return f"""
SELECT source_db, source_job_id, site_id, external_id, title, {text} AS description, country_code, currency, city_id, city_title, category,
  salary_min, published_at, expires_at, subcategory
FROM (
  SELECT o_orderkey, lower(r_name) AS source_db, o_orderkey AS source_job_id, CAST(o_orderkey % 7 AS SMALLINT) AS site_id,
    'ext-' || CAST(o_orderkey % 5000 AS VARCHAR(20)) AS external_id, {_case("o_orderkey", [f"'{t}'" for t in TITLES])} AS title,
    {dates["en"]} AS en, {dates["iso"]} AS iso, {dates["dmy"]} AS dmy, {dates["opening"]} AS opening,
    CASE n_nationkey % 6 WHEN 0 THEN 'us' WHEN 1 THEN 'FR' WHEN 2 THEN 'USA' WHEN 3 THEN NULL WHEN 4 THEN ' de ' ELSE 'CA' END AS country_code,
    CASE n_nationkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN NULL ELSE 'dollar' END AS currency,
    c_custkey AS city_id, c_name AS city_title, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS category,
    CAST(o_totalprice AS DECIMAL(15,2)) AS salary_min, o_orderdate AS published_at,
    CASE WHEN o_orderkey % 11 <> 0 THEN {expires} END AS expires_at,
    CASE o_orderkey % 3 WHEN 0 THEN 'Remote - x' WHEN 1 THEN 'onsite' END AS subcategory
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
) AS rows_of_orders
"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the tables in ``sf_dir``; only the columns that a query uses are read."""
    for name in ("orders", "customer", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(postings_sql(True))
