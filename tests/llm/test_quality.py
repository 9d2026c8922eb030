import re
from collections import Counter

from postwright.llm import quality as Q
from tests.llm.fixtures import ROWS, documents, no_documents


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


EXTRA = [
    (100, "a b c a b c a b c " * 20), (101, "same line here\nsame line here\nother\n\n\nsame line here\n" + "fine words go on " * 20),
    (102, "WORD!! " * 60), (103, "x### y$$$ z%%% " * 30), (104, "home | news | help | more\n" * 3 + "Plain sentence with several words. " * 30),
    (105, "All rights reserved.\n" + " ".join(f"w{i}" for i in range(80)) + "."), (106, "t t t t t"), (107, " ".join(f"v{i}" for i in range(60)) + "."),
]


def test_base_counts(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS + EXTRA)]
    found = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in found}
    assert got == {i: base(t) for i, t in rows}
    for r in found:
        n, _, _, _, repeated = base(rows[r["doc_id"]][1])
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_verdicts(spark):
    found = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(EXTRA, "doc_id long, text string")).collect()}
    assert not found[102]["kept"] and not found[103]["kept"] and found[105]["kept"] and found[107]["kept"]
    assert found[105]["clean_text"].startswith("w0") and found[101]["clean_text"].count("same line here") == 1


LINES = {
    "no end mark": "this line has many words but it just stops", "teaser": "This goes on and on...", "dots": "More of this …",
    "separators": "News | Sport | Weather", "crumbs": "Start » Shop » Shoes » Red", "links": "See https://example.org/a/very/long/path/to/a/page here.",
    "reserved": "© 2024 Example. All rights reserved.", "french": "Tous droits réservés.", "german": "Alle Rechte vorbehalten. Cookies akzeptieren.", "spanish": "Política de privacidad.",
    "home": "Home", "suite": "Lire la suite", "zurueck": "Zurück", "mas": "Leer más", "shout": "THIS IS LOUD.", "signs": "a# b$ c% d&.",
}
FINE = ["A plain sentence of some words.", "He said: “No (never).”", "A short heading", "It ends with a colon:", "See www.x.org for all of the many other details.", "It is not | a row of links at all, as it goes on in words."]


def test_each_line_rule(spark):
    rows = [(k, v) for k, v in LINES.items()] + [(f"fine {i}", v) for i, v in enumerate(FINE)]
    found = dict(map(tuple, spark.createDataFrame(rows, "name string, line string").select("name", Q.line_fails(Q.F.col("line"))).collect()))
    assert all(found[k] for k in LINES), {k for k in LINES if not found[k]}
    assert not any(found[f"fine {i}"] for i in range(len(FINE)))


def test_runs_of_short_lines(spark):
    good = "A plain sentence of some words."
    texts = ["One\nTwo\nThree\nFour\n" + good, "One\nTwo\n\nThree\nFour\n" + good, "One\nTwo\nThree\n" + good + "\nFour", good + "\nOne two\nTwo.\nThree\nFour\nFive six\nSeven"]
    found = [r["clean_text"] for r in Q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert found == [good, texts[1], texts[2], good + "\nOne two\nTwo."]


def test_the_sql_agrees_line_by_line(spark, tmp_path):
    import duckdb

    texts = ["\n".join(LINES.values()), "\n".join(FINE), "One\nTwo\nThree\nFour\n" + " ".join(FINE * 4), *[f"{v}\n" + FINE[0] for v in LINES.values()], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
        want = db.execute(f"SELECT doc_id, lost_share, kept FROM ({Q.ORACLE}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in Q.judge(docs).select("doc_id", "lost_share", "kept").orderBy("doc_id").collect()] == want


def test_clean_lines_keeps_columns(spark):
    docs = documents(spark)
    out = Q.clean_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    for r in out.select("text", "n_chars").collect():
        assert r["n_chars"] == len(r["text"])
    assert Q.clean_lines(no_documents(spark)).count() == 0
    assert Q.judge(no_documents(spark)).count() == 0
