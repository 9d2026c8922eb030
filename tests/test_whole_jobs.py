"""Queries that do the whole job, against brute force over the same tables."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from postwright.operators import labelling as B
from postwright.plans import catalogue
from tests.conftest import SF


def rows_of(name, *columns):
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pylist()


def test_export_holds_every_whole_text(spark):
    got = sorted(tuple(r) for r in catalogue.queries()["training_export"](spark, SF).collect())
    plain = lambda text: re.sub("<[^>]*>", " ", text or "").strip(" ")
    want = sorted(("", r["source"] or "", plain(r["text"]), 1 + r["doc_id"] % 21) for r in rows_of("documents", "doc_id", "source", "text"))
    assert got == want


def test_dry_run_compares_every_row(spark):
    from postwright.operators import process as W
    from postwright.plans import html_queries as H

    got = {r["source_job_id"]: r for r in catalogue.queries()["dry_run_diff"](spark, SF).collect()}
    rows = H._marked(spark, SF).withColumn("full", F.lit(1))
    done = {r["source_job_id"]: r for r in W.process(rows, "source_job_id", H._as_of()).collect()}
    again = {r["source_job_id"]: r for r in W.reevaluate(rows, "source_job_id", H._as_of()).collect()}
    assert set(got) == set(done) == {r["o_orderkey"] for r in rows_of("orders", "o_orderkey")}
    for k, r in got.items():
        a, b = done[k], again[k]
        want = (a["application_email"] != b["email"], a["expiry_date"] != b["expiry_date"], a["description_clean"] != b["description_clean"])
        assert (r["changed_email"], r["changed_expiry_date"], r["changed_description_clean"], r["would_update"]) == (*want, any(want))
    assert {r["would_update"] for r in got.values()} == {True, False}


def test_would_change_with_nulls(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, None, None), (3, None, "x"), (4, "kept", None)], "k int, email string, expiry_date string")
    found = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None)], "k int, email string, expiry_date string")
    got = sorted(tuple(r) for r in B.would_change(stored, found, "k").collect())
    assert got == [(1, False, False, False), (2, True, False, True), (3, False, True, True), (4, False, False, False)]


def test_upsert_reads_every_key(spark):
    from postwright.plans.sync_queries import _payload

    columns = ("source_db", "source_job_id", "site_id", "external_id", "title", "category")
    rows = sorted((r.asDict() for r in _payload(spark, SF).select(*columns).collect()), key=lambda r: r["source_job_id"])
    conflict = lambda r: (r["source_db"], r["site_id"], r["external_id"])
    old, new, seen = {}, {}, set()
    for r in rows:
        k = r["source_job_id"]
        if k % 3 != 1:
            seen.add(k)
            old[conflict(r)] = r | {"title": "old " + r["title"], "external_id": r["external_id"] + ("-moved" if k % 10 == 0 else ""), "email": "kept@x.example"}
        if k % 2 == 1 or k % 3 == 1:
            seen.add(k)
            new[conflict(r)] = r | {"category": r["category"] if k % 9 else None}
    assert seen == {r["o_orderkey"] for r in rows_of("orders", "o_orderkey")}
    at = {(r["source_db"], r["source_job_id"]): conflict(r) for r in new.values()}
    stay = {conflict(r): r for r in old.values() if at.get((r["source_db"], r["source_job_id"]), conflict(r)) == conflict(r)}
    want = [stay.get(c, {"email": None}) | n | {"category": n["category"] or stay.get(c, {}).get("category")} for c, n in new.items()]
    want += [r for c, r in stay.items() if c not in new]
    got = catalogue.queries()["sync_upsert"](spark, SF).collect()
    line = lambda r: tuple(r[c] for c in (*columns, "email"))
    assert sorted(map(repr, map(line, got))) == sorted(map(repr, map(line, want)))


def test_full_processing_detects_and_categorises_every_row(spark):
    got = catalogue.queries()["process_full"](spark, SF).collect()
    assert {r["source_job_id"] for r in got} == {r["o_orderkey"] for r in rows_of("orders", "o_orderkey")} and len(got) == len({r["source_job_id"] for r in got})
    local = [r for r in got if r["language_code"] in ("en", "fr")]
    assert local and len(local) < len(got) and {"en", "fr"} <= {r["language_code"] for r in local}
    assert all(r["category"]["id"] and r["category"]["title"] and 0 < r["category"]["confidence"] <= 1 for r in local)
    assert all(r["category"]["title"] and r["category"]["confidence"] is None and r["application_email"] is None and r["expiry_date"] is None for r in got if r not in local)


def test_full_processing_passes_other_languages_through(spark):
    from postwright.operators import process as W
    from postwright.plans import html_queries as H

    texts = {r["lang"]: r["text"] for r in rows_of("documents", "text", "lang") if len(r["text"] or "") > 400}
    body = "<p>{}</p><p>Apply to jane@acme.example</p>"
    rows = spark.createDataFrame([(i, "Koch - Vollzeit", body.format(t), "2-high", 1) for i, t in enumerate(texts.values())], "source_job_id long, title string, description string, original_category string, full int")
    posted = H._marked(spark, SF)
    got = {r["source_job_id"]: r for r in W.process(rows, "source_job_id", H._as_of(), H._languages(spark, SF, rows), H._categoriser(spark, posted)).collect()}
    assert [got[i]["language_code"] for i in range(len(texts))] == list(texts) and {"en", "fr", "de", "es"} <= set(texts)
    for i, lang in enumerate(texts):
        assert (got[i]["application_email"] is None) == (lang in ("de", "es")) == (got[i]["category"]["id"] is None)


def test_term_statistics_count_all_documents_and_pairs(spark):
    count, docs = Counter(), rows_of("documents", "source", "text")
    for r in docs:
        words = re.findall(r"\w\w+", " ".join(x for x in [r["source"]] * 3 + [r["text"]] if x is not None).lower())
        count.update({*words, *map(" ".join, zip(words, words[1:]))})
    got = {r["term"]: (r["documents"], r["idf"]) for r in catalogue.queries()["tfidf_term_stats"](spark, SF).collect()}
    assert {t: n for t, (n, _) in got.items()} == dict(count) and any(" " in t for t in got)
    assert all(abs(idf - (math.log((1 + len(docs)) / (1 + n)) + 1)) < 1e-6 for n, idf in got.values())


def test_every_text_gets_a_result(spark):
    from postwright.operators import language_model as LM

    docs = rows_of("documents", "doc_id", "text", "lang")
    found = {r["doc_id"]: r["detected"] for r in catalogue.queries()["lang_detect"](spark, SF).collect()}
    assert set(found) == {r["doc_id"] for r in docs}
    assert all(found[r["doc_id"]] for r in docs if re.search(r"[^\W\d_]", r["text"] or ""))
    assert sum(found[r["doc_id"]] == r["lang"] for r in docs) >= 0.97 * len(docs)
    taught = spark.createDataFrame([("en", "the quick brown fox"), ("de", "über große Flüsse")], "lang string, text string")
    rare = spark.createDataFrame([(1, "quickest"), (2, "größte"), (3, ""), (4, None), (5, "12 !"), (6, "你")], "k int, text string")
    got = LM.detect(rare, "k", F.col("text"), LM.fit(taught)).collect()
    assert {r["k"]: r["lang"] for r in got} == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: None}


def test_trigram_scores(spark):
    from postwright.operators import language_model as LM

    docs, grams = rows_of("documents", "doc_id", "text", "lang")[:40], {}
    cut = lambda t: [f"_{w}_"[i : i + 3] for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for i in range(len(w))]
    for r in docs:
        grams.setdefault(r["lang"], Counter()).update(cut(r["text"]))
    types = len(set().union(*grams.values()))
    model = LM.fit(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string")).collect()
    assert len(model) == types * len(grams)
    assert all(abs(r["log_p"] - math.log((grams[r["lang"]][r["gram"]] + 1) / (sum(grams[r["lang"]].values()) + types))) < 1e-9 for r in model)


def test_a_run_reads_sites_with_long_ids(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for name in ("orders", "customer", "nation", "region", "events", "supplier"):
        more = " UNION ALL SELECT * REPLACE (s_suppkey + 32768 AS s_suppkey) FROM '{0}'" if name == "supplier" else ""
        con.execute(f"COPY (SELECT * FROM '{{0}}'{more}) TO '{tmp_path}/{name}.parquet'".format(f"{SF}/{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = catalogue.queries()["sync_run"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(catalogue.oracle_sql()["sync_run"]).fetchall(), key=repr)
    assert {r["source_db"] for r in got if r["failed"]} == {"asia", "europe"}


def test_full_processing_deals_rows_over_all_cores(spark, monkeypatch):
    from postwright.plans import html_queries as H

    seen = []
    monkeypatch.setattr(H, "_languages", lambda *a: None)
    monkeypatch.setattr(H, "_categoriser", lambda *a: None)
    monkeypatch.setattr(H.W, "process", lambda rows, *a: seen.append(rows))
    catalogue.queries()["process_full"](spark, SF)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    whole = len(rows_of("orders", "o_orderkey"))
    assert sum(sizes) == whole and len(sizes) == 8 and max(sizes) < 2 * whole / 8


def test_a_repeated_page_is_parsed_once(monkeypatch):
    import pandas as pd

    from postwright.html import udf

    calls, parse, pages = [], udf.parse_posting, ["<p>a</p>", "<p>b</p>", None, "<p>a</p>", "<p>c</p>" * 9, None]
    monkeypatch.setattr(udf, "parse_posting", lambda raw: calls.append(raw) or parse(raw))
    got = pd.concat(udf._parse(iter([pd.Series(pages, dtype=object), pd.Series(pages, dtype=object)])))
    assert got.to_dict("records") == [parse(x) for x in pages + pages] and len(calls) == 4
    monkeypatch.setattr(udf, "REMEMBERED", 16)  # longer pages are never held, and others go when they don't fit
    assert pd.concat(udf._parse(iter([pd.Series(pages, dtype=object)]))).to_dict("records") == [parse(x) for x in pages]


def test_full_processing_handles_each_page_once(spark, monkeypatch):
    from postwright.plans import html_queries as H

    seen, posted = [], H._marked(spark, SF)
    monkeypatch.setattr(H, "_languages", lambda *a: seen.append(a[2]))
    monkeypatch.setattr(H, "_categoriser", lambda *a: seen.append(a[1]))
    monkeypatch.setattr(H.W, "process", lambda rows, *a: seen.append(a[-1]))
    catalogue.queries()["process_full"](spark, SF)
    pages = {(r["title"], r["description"]) for r in posted.select("title", "description").collect()}
    for once in (seen[0], seen[2]):
        got = [(r["title"], r["description"]) for r in once.collect()]
        assert set(got) == pages and len(got) == len(pages) < posted.count()
    labels = Counter((r["title"], r["description"], r["original_category"].lower()) for r in posted.collect())
    assert {(r["title"], r["description"], r["original_category"]): r["n"] for r in seen[1].collect()} == labels


def test_requests_get_the_results_of_their_pages(spark):
    from postwright.operators import process as W
    from postwright.plans import html_queries as H

    texts = ["<p>Apply by June 5, 1996</p><p>Apply to jane@acme.example</p>", "<p>Sueldo</p>", "", "<p>Start date: 1996-07-01</p>", None]
    rows = [(i // 2, f" Title {i % 3}" if i % 7 else None, texts[i % 5], ("Care", None)[i % 2], i % 11 % 2) for i in range(60)]
    rows = spark.createDataFrame(rows, "k long, title string, description string, original_category string, full int").withColumn("page", W.page_key("title", "description", "full"))
    pages = rows.select("page", "title", "description", "full").distinct()
    langs = pages.select("page", F.when(F.col("description").contains("Sueldo"), "es").when(F.col("description") != "", "en").alias("lang"))
    category = F.struct(F.lit(7).cast("long").alias("id"), F.col("text").alias("title"), F.lit(0.5).alias("confidence")).alias("category")
    numbered = rows.withColumn("n", F.monotonically_increasing_id()).localCheckpoint()
    one = W.process(numbered, "n", H._as_of(), numbered.join(langs, "page").select("n", "lang"), lambda posts: posts.select("n", category))
    many = W.process(rows, "k", H._as_of(), langs, lambda posts: posts.select("page", category), None, pages)
    want = [tuple(r)[1:] for r in numbered.select("k", "n").join(one, "n").collect()]
    assert pages.count() < rows.count() == len(want)
    assert sorted(map(repr, map(tuple, many.collect()))) == sorted(map(repr, want))


def test_weights_stand_for_equal_rows(spark, monkeypatch):
    from postwright.operators import categorise as C

    once = [(f"{w} {x} job", float(y), 1 + (3 * i + 5 * y) % 7) for i, (w, x) in enumerate([("cook", "night"), ("cook", "day"), ("nurse", "day"), ("clerk", "night"), ("nurse", "ward")]) for y in range(3)]
    schema = "input string, label double, n int"
    weighted, repeated = spark.createDataFrame(once, schema).coalesce(1), spark.createDataFrame([r for r in once for _ in range(r[2])], schema).coalesce(1)
    options = {"iterations": 500, "tolerance": 1e-12, "penalty": 0.05}
    models = [C.fit(repeated, size=8, **options)]
    for finest in (1 << 18, 20, 1):
        monkeypatch.setattr(C, "FINEST", finest)
        models.append(C.fit(weighted, size=8, weight="n", **options))
    found = [{r["input"]: r["probability"].toArray() for r in m.transform(weighted.select("input").distinct()).collect()} for m in models]
    assert all(abs(p - f[k]).max() < 1e-6 for f in found[1:] for k, p in found[0].items()) and len(found[0]) == 5
    # the number of equal rows matters
    plain = C.fit(weighted.drop("n"), size=8, **options).transform(weighted).first()
    assert abs(plain["probability"].toArray() - found[0][plain["input"]]).max() > 1e-3
