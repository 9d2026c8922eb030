"""Flows that write or need a model: schemas, runs, reports, the category model, generated titles."""

import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from postwright.functions import titles as T
from postwright.operators import categorise as C
from postwright.operators import labelling as B
from postwright.operators import report as RP
from postwright.operators import sync_run as SR
from postwright.sources import schema as SC
from postwright.sources import shared


def test_schemas_are_created_once_and_conform(spark, tmp_path):
    base = str(tmp_path / "target")
    SC.create(spark, base)
    SC.create(spark, base)
    assert SC.table_exists(spark, f"{base}/jobs") and not SC.table_exists(spark, f"{base}/nothing")
    jobs = spark.read.parquet(f"{base}/jobs")
    assert jobs.count() == 0 and jobs.schema == SC.declared("jobs") and SC.column_exists(jobs, "language_code") and not SC.column_exists(jobs, "lang")
    old = spark.createDataFrame([("7", "x")], "id string, db string")
    row = SC.conform(old, SC.TABLES["jobs"], {"db": "source_db"}).first()
    assert (row["id"], row["source_db"], row["title"]) == (7, "x", None)


def test_seeds_and_mapping_load_twice_alike(spark, tmp_path):
    (tmp_path / "map.csv").write_text("original_category,category_id\nFood,3\nFOOD,3\nCare,4\n")
    mapping = SC.read_mapping(spark, str(tmp_path / "map.csv"))
    assert sorted(map(tuple, mapping.collect())) == [("care", 4), ("food", 3)]
    stored = spark.createDataFrame([("food", 9), ("other", 1)], mapping.schema)
    once = SC.load_seeds(stored, mapping, "original_category")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, SC.load_seeds(once, mapping, "original_category").collect())) == [("care", 4), ("food", 3), ("other", 1)]
    assert SC.load_seeds(None, mapping, "original_category").count() == 2


def test_a_failing_source_leaves_the_others_alone(spark):
    def good(n):
        jobs = spark.createDataFrame([(i, 1, 1, "e", "Cook", "text") for i in range(1, n + 1)], "id long, city_id long, site_id smallint, external_id string, position string, description string")
        cities = spark.createDataFrame([(1, "Paris")], "id long, title string")
        return SR.Source(jobs, cities, spark.createDataFrame([(1, "site")], "id smallint, name string"), country_code="FR", currency="EUR")

    applied = {}

    def apply(name, batch):
        if name == "breaks":
            raise OSError("disk full")
        applied[name] = [r.asDict() for r in batch.rows.collect()]

    sources = {"a": lambda: good(3), "none": lambda: 1 / 0, "breaks": lambda: good(5), "b": lambda: good(2)}
    found = {r["source_db"]: r for r in SR.run(spark, sources, {"a": 1}, "ai", F.lit("2026-01-01").cast("timestamp"), apply).collect()}
    assert [found[k]["fetched"] for k in ("a", "none", "breaks", "b", None)] == [2, 0, 0, 2, 4] and found["a"]["last_job_id"] == 3
    assert "ZeroDivisionError" in found["none"]["error"] and "disk full" in found["breaks"]["error"] and found["b"]["error"] is None
    assert len(applied["a"][0]) == 28 and applied["a"][0]["title"] == "Cook" and applied["a"][0]["country_code"] == "FR" and applied["a"][0]["site_title"] == "site"


def test_quota_rechecks_ambiguous_labels(spark):
    rows = [(i, 1, 1 if i % 2 else 2) for i in range(20)] + [(100 + i, None, 1) for i in range(5)]
    candidates = spark.createDataFrame(rows, "k long, mapped long, heuristic long")
    none = spark.createDataFrame([], "k long, category_id long")
    found = B.quota_fill(candidates, none, 10, "k", "s", recheck=F.lit(True)).collect()
    assert {r["k"] % 2 for r in found if r["pass"] == "map"} == {1} and sum(r["pass"] == "map" for r in found) == 8
    assert sum(r["category_id"] == 1 for r in found) == 10 and sum(r["category_id"] == 2 for r in found) == 10
    assert len({r["k"] for r in found}) == len(found)


def test_report_is_escaped_and_bounded(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"<b>{i}</b> & '\"", None if i % 2 else "x@y.z") for i in range(9)], "k long, raw string, email string")
    pages = RP.report(rows, "k", F.col("raw"), F.lit("<p>ok</p>"), {"email": F.col("email")}, {"email": F.col("email").isNotNull()}, 3)
    RP.write(pages, str(tmp_path / "report"), "Run")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "rows: 9 · email: 5 (55.6%)" in text and text.count("<section>") == 3 and "&lt;b&gt;0&lt;/b&gt; &amp; &#x27;&quot;" in text and "<b>" not in text


def test_category_model_search_save_and_load(spark, tmp_path):
    rows = [(f"{w} {w} and {'nurse care ward' if y else 'cook kitchen food'} {i}", float(y)) for i in range(40) for y, w in ((0, "salt"), (1, "pill"))]
    data = spark.createDataFrame(rows, "input string, label double")
    model, tried = C.search(data, [1e-3, 10.0], [0.0], size=256)
    assert len(tried) == 2 and max(a for _, a in tried) == 1.0
    C.save(model, str(tmp_path / "m"))
    again = C.load(str(tmp_path / "m"))
    assert C.evaluate(again, data)["accuracy"] == 1.0 and C.evaluate(again, data)["logLoss"] < 0.7
    vector = again.transform(data).first()["features"]
    assert abs(sum(x * x for x in vector.values) - 1) < 1e-9
    with pytest.raises(RuntimeError):
        C.load(str(tmp_path / "none"))
    assert C.load_if_any(str(tmp_path / "none")) is None


def test_generated_titles_fall_back(spark):
    rows = spark.createDataFrame([(0, "Cook - Full Time"), (1, "Driver"), (2, None)], "k int, title string")
    shout = T.generated(F.col("title"), lambda: lambda prompts: [p.removeprefix("normalize job title: ").upper() for p in prompts])
    assert {r["k"]: r["t"] for r in rows.select("k", shout.alias("t")).collect()} == {0: "COOK", 1: "DRIVER", 2: ""}

    def broken():
        raise OSError("no model")

    for load in (broken, lambda: lambda prompts: 1 / 0):
        made = T.generated(F.col("title"), load)
        got = rows.select("k", T.normalise_with_fallback(F.col("title"), made).alias("t")).collect()
        assert {r["k"]: r["t"] for r in got}[0] == "Cook"


def test_references_as_the_standard_library_reads_them(spark):
    rng, names = random.Random(1), list(html5)
    texts = ["&#39;", "&#x27;x", "&notit;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999;", "&#1;", "&bogus;", "&", "&#;", "&#129;", "a &lt b", "plain"]
    texts += ["".join(rng.choice([f"&{rng.choice(names)}", f"&#{rng.randrange(70000)};", f"&#x{rng.randrange(1200000):x}", " ", "b;", "&"]) for _ in range(4)) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.unescape(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in got} == {i: html.unescape(x) for i, x in enumerate(texts)}


def test_staged_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(shared, "_own", lambda s: f"{shared.shared_dir(s)}/postwright/test-clear")
    staged = shared.stage(spark.range(3).toDF("x"), "probe")
    path = staged.inputFiles()[0]
    assert staged.count() == 3 and SC.table_exists(spark, path)
    shared.clear(spark)
    assert not SC.table_exists(spark, path)
