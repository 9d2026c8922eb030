"""Personal data by patterns, and identifiers discovered by bootstrapping contexts, in DataFrame functions only.

Base kinds (e-mail, IP address, payment card, phone number) are found by fixed
patterns. They seed one graph per kind; strings that are unmistakable by their form
or assignment seed a fifth, of other identifiers. Two sorts of lexical patterns
stand on one side of a graph, values on the other: a cue (the word and the signs
left of a value) and a shape (what a value is made of). Spark scores the graphs
in rounds. A pattern is as good as the share of known values in all that it
meets: for cues that is every place of the corpus where the cue occurs, so a common
word is never a good cue. Values at a good cue become known, with a score from all
their patterns, and count as seeds in the next round. What stands at a good cue in the
end, and isn't a base span, is reported.

Values are all tokens with a digit (digit groups may hold single blanks, dots,
hyphens and brackets) and all tokens, of letters too, after an assigning sign.
Letters alone after plain words are no values.

Defined results: a null or empty text has no spans. Base matches that fail their
check are dropped without a retry. A value that two kinds claim goes to the higher
confidence, on a tie to the greater kind name. Texts of any length are searched
whole: no pattern backtracks over them. Rows that repeat a doc_id, or a whole row, are
told apart by a row number and give one row each; a null doc_id stays null. An
empty table gives an empty table. Extra columns pass ``redact`` untouched and are
ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.llm.common import replace_text, stage

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "id"
_LOCAL = "[A-Za-z0-9._%+-]"

#: The contract's patterns, written so that no text makes them backtrack: a match
#: starts where a run of its first characters starts, or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

#: Characters of a value inside; a value that may be an identifier: a token with a digit, or one after an assigning sign.
_IN = r"\p{L}\p{N}_@%./+-"
_GROUPS = r"\(?[0-9]{1,6}\)?(?:[ ./-]\(?[0-9]{1,6}\)?)++(?![\p{L}\p{N}])"
VALUE = rf"(?<![{_IN}])(?:(?=\(?[\p{{L}}_@%./+-]*+[0-9])|(?<=[=:#][\s\"'(\[]{{0,3}}))(?:{_GROUPS}|[\p{{L}}\p{{N}}](?:[{_IN}]*[\p{{L}}\p{{N}}])?)"
VALUE_NEEDS = "[0-9=:#]"
#: The cue of a value: the word left of it and the signs between, in lower case with single blanks; read from this many characters.
CUE, CONTEXT = r"(?<![\p{L}_])[\p{L}_]++[^\p{L}\p{N}_+]++", 40
#: Seeds of kind ``id``: values of these assignments and values with these prefixes, which are reported; random keys, which only seed.
SEED_CUE, SEED_VALUE = r"(?:password|passwd|secret|api_?key|access_?key)\W*[=:]\W*$", "^(?:AKIA|ASIA|ghp_|sk-)[A-Za-z0-9_-]{8,}$"
KEY = r"^(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[0-9A-Za-z]{24,})$"
#: Rounds over the graphs at most; what is added to the places of a pattern; least confidence and known values of a cue that discovers.
ROUNDS, SMOOTHING, ACCEPT, SUPPORT = 4, 2.0, 0.6, 3
#: Cues that are broadcast at most when the corpus is counted; more are counted by a shuffle.
BROADCAST_CUES = 200_000
#: Matches of a text that one inner pass gathers.
BLOCK = 128
_CUED = "array<struct<start:bigint,end:bigint,value:string,cue:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    reversed_digits = F.split(F.reverse(_digits(match)), "")

    def add(total: Column, digit: Column, i: Column) -> Column:
        d = digit.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    numbered = F.transform(F.filter(reversed_digits, lambda d: d != ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    total = F.aggregate(numbered, F.lit(0), lambda a, x: add(a, x["d"], x["i"]))
    return F.length(_digits(match)).between(13, 19) & (total % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(13, 19), _luhn(match)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places and cues: array<struct<start, end, value, cue>>, in code points.

    The texts between the matches come from a split by the same pattern; sums of
    both lengths give the places in one pass, and their ends what stands left of a
    match. Matches are gathered block by block, so that time grows with the text.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    state = lambda at, left, spans: F.struct(at.alias("at"), left.alias("left"), spans.alias("spans"))

    def add(a: Column, p: Column) -> Column:
        start, left = a["at"] + F.length(p["gap"]), F.right(F.concat(a["left"], p["gap"]), F.lit(CONTEXT))
        end = start + F.length(p["value"])
        span = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), _cue(left).alias("cue"))
        return state(end, F.right(F.concat(left, p["value"]), F.lit(CONTEXT)), F.array_append(a["spans"], span))

    def add_block(all_pairs: Column, a: Column, i: Column) -> Column:
        block = F.aggregate(F.slice(all_pairs, i * BLOCK + 1, F.lit(BLOCK)), state(a["at"], a["left"], F.array().cast(_CUED)), add)
        return F.element_at(F.transform(F.array(block), lambda b: state(b["at"], b["left"], F.array_append(a["spans"], b["spans"]))), 1)

    def blocks(found: Column) -> Column:
        zero = state(F.lit(0).cast("long"), F.lit(""), F.array().cast(f"array<{_CUED}>"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
        return F.when(F.size(found) > 0, F.aggregate(numbers, zero, lambda a, i: add_block(found, a, i), lambda a: F.flatten(a["spans"]))).otherwise(F.array().cast(_CUED))

    return F.element_at(F.transform(F.array(F.filter(pairs, lambda p: p["value"].isNotNull())), blocks), 1)


def _cue(left: Column) -> Column:
    """The cue at the end of what stands left of a value; null if there is none, or if it may be cut off."""
    found = F.regexp_extract(F.regexp_replace(F.lower(left), r"\s+", " "), f"({CUE})$", 1)
    return F.when((found != "") & (F.length(found) < CONTEXT), found)


def scanned(docs: DataFrame) -> DataFrame:
    """Adds a column per base kind, and ``values`` of all kinds of values: array<struct<start, end, value, cue>> of ``text``."""
    text, none = F.coalesce("text", F.lit("")), F.array().cast(_CUED)
    def spans(kind: str) -> Column:
        return F.when(text.rlike(NEEDS[kind]), F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))).otherwise(none)

    return docs.withColumns({**{k: spans(k) for k in KINDS}, "values": F.when(text.rlike(VALUE_NEEDS), _located(text, VALUE)).otherwise(none)})


def _shape(value: Column) -> Column:
    """What a value is made of: runs of one class as one sign, long mixtures as a star."""
    out = value
    for pattern, sign in (("[0-9]+", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A"), (r"[\p{L}&&[^aA]]+", "l"), ("(?:9[aA]|[aA]9){2,}[9aA]?", "*")):
        out = F.regexp_replace(out, pattern, sign)
    return out


def _occurrences(staged: DataFrame) -> DataFrame:
    """row, start, end, value, cue, kind (of a seed, or null), base, certain: base spans, and values that overlap none."""
    def seeds(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["cue"].alias("cue"), F.lit(kind).alias("kind"), F.lit(True).alias("base"), F.lit(True).alias("certain")))

    known = F.concat(*[seeds(k) for k in KINDS])
    base = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    free = F.filter("values", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    certain = lambda s: F.coalesce(s["cue"].rlike(SEED_CUE), F.lit(False)) | s["value"].rlike(SEED_VALUE)
    open_ = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["cue"].alias("cue"), F.when(certain(s) | s["value"].rlike(KEY), DISCOVERED).alias("kind"), F.lit(False).alias("base"), certain(s).alias("certain")))
    return staged.select("row", F.explode(F.concat(known, open_)).alias("o")).select("row", "o.*")


def cue_totals(texts: DataFrame, cues: DataFrame) -> DataFrame:
    """(pattern, total): how often each of the distinct ``cues`` (pattern: "near " and the cue) stands anywhere in ``texts`` (text)."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")
    every = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(f"({CUE})"), F.lit(1))).alias("cue")).select(F.concat(F.lit("near "), "cue").alias("pattern"))
    if cues.count() <= BROADCAST_CUES:
        return every.join(F.broadcast(cues), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))
    return every.groupBy("pattern").agg(F.count("*").alias("total")).join(cues, "pattern", "left_semi")


def score_graphs(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``edges(pattern, instance, n, kind)``, ``totals(pattern, total)`` -> (pattern, kind, confidence, support) of the good cues, each under its best kind.

    n: how often the pattern meets the instance; kind: the instance's kind if it is a
    seed. Every round sums what patterns meet, by partial aggregation, and joins on
    keys that adaptive execution can split; nothing is gathered.
    """
    seeds = stage(edges.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    known, size = seeds, seeds.count()
    while True:
        hits = edges.drop("kind").join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("support"))
        patterns = stage(hits.join(totals, "pattern").select("pattern", "kind", (F.col("hits") / (F.col("total") + SMOOTHING)).alias("confidence"), "support"), "pii-patterns")
        good = patterns.filter(F.col("pattern").startswith("near ") & (F.col("confidence") >= ACCEPT) & (F.col("support") >= SUPPORT))
        good = good.groupBy("pattern").agg(F.max(F.struct("confidence", "kind", "support")).alias("b")).select("pattern", "b.kind", "b.confidence", "b.support")
        rounds -= 1
        if not rounds:
            return good
        met = edges.select("pattern", "instance").join(good.select("pattern", "kind"), "pattern").select("instance", "kind").distinct()
        met = met.join(seeds.select("instance"), "instance", "left_anti")
        scored = edges.select("pattern", "instance").join(met, "instance").join(patterns, ["pattern", "kind"])
        scored = scored.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        known = stage(seeds.unionByName(best), "pii-known")
        if (now := known.count()) == size:
            return good
        size = now


def find(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row, doc_id, a span column per base kind, and ``id`` for what the method adds.

    Spans are array<struct<start, end, value>>, in code points of the text, ends
    exclusive; those of ``id`` also name the kind that they were taken for. Columns named in ``carry`` are passed through.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *carry)
    staged = stage(scanned(docs).drop("text"), "pii-spans")
    places = stage(_occurrences(staged), "pii-places")
    cue, shape = F.concat(F.lit("near "), "cue"), F.concat(F.lit("shape "), _shape(F.col("value")))
    edges = places.select(F.explode(F.array(cue, shape)).alias("pattern"), F.col("value").alias("instance"), "kind").filter("pattern IS NOT NULL")
    edges = stage(edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "pii-edges")
    own = edges.groupBy("pattern").agg(F.sum("n").alias("own"), F.count("*").alias("values"))
    # a cue of fewer values can't get enough support: it is neither counted nor scored
    own = stage(own.filter(~F.col("pattern").startswith("near ") | (F.col("values") >= SUPPORT)), "pii-own")
    counted = cue_totals(docs.select("text"), own.filter(F.col("pattern").startswith("near ")).select("pattern"))
    totals = stage(own.join(counted, "pattern", "left").select("pattern", F.greatest("own", F.coalesce("total", F.lit(0))).alias("total")), "pii-totals")
    good = score_graphs(edges, totals)
    new = places.filter("NOT base").withColumn("pattern", cue).join(good.select("pattern", F.col("kind").alias("found")), "pattern", "left").filter("certain OR found IS NOT NULL")
    new = new.select("row", F.struct("start", "end", "value", F.coalesce("found", F.lit(DISCOVERED)).alias("kind")).alias("s")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias(DISCOVERED))
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(k) for k in KINDS]
    whole = staged.join(new, "row", "left")
    return whole.select("row", "doc_id", *plain, F.coalesce(DISCOVERED, F.array().cast("array<struct<start:bigint,end:bigint,value:string,kind:string>>")).alias(DISCOVERED), *carry)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one. n_chars follows the text, if there is one."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    found, text = find(whole, ("__doc",)), F.coalesce("__doc.text", F.lit(""))

    def tagged(kind: str) -> Column:
        tag = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")) if kind == DISCOVERED else F.lit(f"<{kind.upper()}>")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(s).alias("tag")))

    found = found.withColumn("__spans", F.sort_array(F.concat(*[tagged(k) for k in (*KINDS, DISCOVERED)])))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.array_append(F.array_append(a["parts"], gap), s["tag"]).alias("parts"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))
        )

    end = lambda a: F.array_join(F.array_append(a["parts"], F.substring(text, a["at"].cast("int") + 1, F.length(text))), "")
    clean = F.when(F.size("__spans") > 0, F.aggregate("__spans", zero, add, end)).otherwise(F.col("__doc.text"))
    return replace_text(found.select("__doc", clean.alias("__text")), docs)


def op7(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    names = lambda kinds: F.array_join(F.concat(*[named(k) for k in kinds]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(names(KINDS), 256).alias("base_sha256"), names((*KINDS, DISCOVERED)).alias("spans"))
