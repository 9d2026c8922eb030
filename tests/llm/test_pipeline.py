"""The pipeline's stages against brute force on a small table, and the registry."""

import corpus_pipeline
from postwright.llm import quality, registry, toxicity
from tests.llm.fixtures import documents
from tests.llm.test_neardup import brute_force


def write_tables(spark, where):
    docs = documents(spark, False)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return docs


def test_stages_keep_the_columns_and_their_decisions(spark, tmp_path):
    docs = write_tables(spark, tmp_path)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "near-duplicates", "personal data", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, str(tmp_path))
    scores = toxicity.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert calm.schema == docs.schema and calm.count() == scores.filter(scores.score < toxicity.THRESHOLD).count()
    good = stages["quality rules"](spark, calm, str(tmp_path))
    assert good.columns == docs.columns and good.count() == quality.judge(calm).filter("kept").count()
    once = stages["near-duplicates"](spark, docs, str(tmp_path))
    groups = {(c if c is not None else d) for d, n, c in brute_force(5) if n}
    assert once.columns == docs.columns and once.filter("text RLIKE '[^ \\n\\t]'").count() == len(groups)
    safe = stages["personal data"](spark, once, str(tmp_path))
    assert safe.columns == docs.columns and safe.count() == once.count() and safe.filter("text LIKE '%jane.doe@%'").count() == 0


def test_run_packs_what_is_left(spark, tmp_path):
    write_tables(spark, tmp_path)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and {r["offset"] for r in pieces} >= {0}


def test_run_against_brute_force(spark, tmp_path):
    """Stage by stage in Python, from the texts to the packed ids."""
    import zlib
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from postwright.llm import pii

    docs = write_tables(spark, tmp_path)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scores = Counter((r["doc_id"], r["score"] < toxicity.THRESHOLD) for r in toxicity.score(docs, labels).collect())
    assert all(fine for _, fine in scores)  # the only label is a clean one
    judged = [r for r in quality.judge(docs).collect() if r["kept"]]
    rows, seen, kept = [(r["doc_id"], r["clean_text"]) for r in judged], [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = text.encode().lower().split()
        found = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        if not any(100 * len(found & other) >= 80 * len(found | other) for other in seen):
            kept.append((doc, text))
        seen.append(found)
    redacted = [(r["doc_id"], r["text"]) for r in pii.redact(spark.createDataFrame(kept, "doc_id long, text string")).collect()]
    assert not any("@mail.example.org" in text for _, text in redacted)
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for doc, text in redacted:
        want[doc, len(library.encode(text, add_special_tokens=False).ids) + 1] += 1
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    ids = {doc: [*library.encode(text, add_special_tokens=False).ids, 1] for doc, text in redacted if doc is not None}
    for r in pieces:
        if r["doc_id"] is not None:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"]
    assert sum(r["length"] for r in pieces) == sum(n * k for (_, n), k in want.items())


def test_run_on_an_empty_table(spark, tmp_path):
    documents(spark, False).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_has_every_operator():
    names = [n.split("_")[0] for n in registry.queries()]
    assert names == ["pipeline", *(f"op{i}" for i in range(1, 11))]
    assert set(registry.oracle_sql()) <= set(registry.queries())
