"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: punctuation (symbols, no end mark, a teaser's dots),
shouting, repetition, boilerplate, navigation (words, separators, links, runs of
short lines), an earlier copy in the same text. Lines that fail are removed, and a
document that loses too much of its text is rejected.

Defined results: a null or empty text, or one without words, has counts of 0 and
is rejected. Lines without a word are never judged; they stay, and end a run of short
lines. Of equal lines the first stays. Texts of any length are handled whole, in one
row. Rows are independent: repeated rows get equal results, an empty table gives
none, extra columns pass ``clean_lines`` untouched.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.llm.common import replace_text

#: Limits of the line rules and of the document rules.
SYMBOLS_PER_WORD, CAPITALS_PER_CHAR, LONG_LINE, DISTINCT_SHARE, MAX_LOST = 0.3, 0.5, 10, 1 / 3, 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Words of a line that must end with an end mark; separators of a row of links and its words per separator; share of links in a line.
SENTENCE, SEPARATORS, WORDS_PER_SEPARATOR, LINK_SHARE = 5, 2, 5, 0.5
#: Words of a short line at most, and lines of a run of them.
SHORT, RUN = 3, 4

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
CAPITAL = "\\p{Lu}"
# Java and RE2 read all patterns alike.
#: A line that ends as a sentence does, brackets and quotation marks aside; a teaser; separators between links; a link.
ENDED = "[.!?…:;][)\\]\"'”’»]*[\\x20\\x09-\\x0D]*\\z"
TEASER = "(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z"
SEPARATOR = "[|»›•·]"
LINK = "(?:https?://|www\\.)[^\\x20\\x09-\\x0D]+"
#: Phrases of licences, notices and page furniture, by language (English, French, German, Spanish); looked for where a word starts only.
BOILERPLATE = "(?i)(?:^|[^a-z])(?:" + "|".join(
    (
        "all rights reserved|licensed under|released under the|terms of (use|service)|terms and conditions|privacy policy|cookie policy|accept (all )?cookies",
        "tous droits r[eé]serv[eé]s|conditions (g[eé]n[eé]rales|d['’]utilisation)|politique de confidentialit[eé]|mentions l[eé]gales|accepter (tous )?les cookies|sous licence",
        "alle rechte vorbehalten|nutzungsbedingungen|datenschutz(erkl[aä]rung|richtlinie)|gesch[aä]ftsbedingungen|(alle )?cookies (akzeptieren|zulassen)|lizenziert unter",
        "todos los derechos reservados|t[eé]rminos (de uso|y condiciones)|pol[ií]tica de (privacidad|cookies)|aviso legal|aceptar (todas las )?cookies|bajo (la )?licencia",
    )
) + ")"
#: Whole lines, and the words of the longest.
NAVIGATION_WORDS = 3
NAVIGATION = "(?i)^\\s*(" + "|".join(
    (
        "home|menu|log ?in|sign (in|up)|subscribe|next|previous|back to top|read more|share|skip to content|contact( us)?|search",
        "accueil|connexion|s['’]inscrire|s['’]abonner|suivant|pr[eé]c[eé]dent|haut de page|lire la suite|partager|contactez-nous|rechercher",
        "startseite|men[uü]|anmelden|registrieren|abonnieren|weiter|zur[uü]ck|nach oben|weiterlesen|teilen|kontakt|suche",
        "inicio|men[uú]|iniciar sesi[oó]n|registrarse|suscribirse|siguiente|anterior|volver arriba|leer m[aá]s|compartir|contacto|buscar",
    )
) + ")\\s*$"


def split_words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def judge_line(line: Column, may_link: Column | None = None, may_separate: Column | None = None) -> Column:
    """struct<fails, short> of a line that has words: whether a rule of its own fails (earlier copies are the document's affair), and whether it may be in a run of short lines.

    ``may_link`` and ``may_separate``: whether its text can hold a link or a separator at all.
    """
    yes = F.lit(True)
    ended = line.rlike(ENDED)
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    linked = F.length(F.array_join(F.regexp_extract_all(line, F.lit(f"({LINK})"), F.lit(1)), ""))
    bound = F.transform(F.array(split_words(line)), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("distinct"), ended.alias("ended")))
    fails = lambda x: (
        ((x["n"] >= SENTENCE) & ~x["ended"])
        | (F.regexp_count(line, F.lit(SYMBOL)) > SYMBOLS_PER_WORD * x["n"])
        | (F.regexp_count(line, F.lit(CAPITAL)) > CAPITALS_PER_CHAR * x["chars"])
        | ((x["n"] >= LONG_LINE) & (x["distinct"] < DISTINCT_SHARE * x["n"]))
        | (x["ended"] & line.rlike(TEASER))
        | ((x["n"] <= NAVIGATION_WORDS) & line.rlike(NAVIGATION))
        | ((yes if may_separate is None else may_separate) & (separators >= SEPARATORS) & (x["n"] <= WORDS_PER_SEPARATOR * separators))
        | ((yes if may_link is None else may_link) & line.rlike(LINK) & (linked > LINK_SHARE * x["chars"]))
        | line.rlike(BOILERPLATE)
    )
    return F.element_at(F.transform(bound, lambda x: F.struct(fails(x).alias("fails"), ((x["n"] <= SHORT) & ~x["ended"]).alias("short"))), 1)


def line_fails(line: Column) -> Column:
    """Whether a line that has words fails a rule of its own."""
    return judge_line(line)["fails"]


def _with_lines(docs: DataFrame) -> DataFrame:
    """Adds __lines: struct<line, fails> in order; fails is null for a line without words."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    text = F.coalesce("text", F.lit(""))
    holds = F.struct((F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))).alias("link"), text.rlike(SEPARATOR).alias("separator"))

    def judged(x: Column, text_holds: Column) -> Column:
        verdict = F.when(_has_word(x), judge_line(x, text_holds["link"], text_holds["separator"]))
        return F.element_at(F.transform(F.array(verdict), lambda v: F.struct(x.alias("line"), v["fails"].alias("fails"), F.coalesce(v["short"], F.lit(False)).alias("short"))), 1)

    # what the text holds is bound once: a column would be computed again for every line
    docs = docs.withColumn("__rules", F.element_at(F.transform(F.array(holds), lambda h: F.transform(lines, lambda x: judged(x, h))), 1))
    # a short line is in a run if some window of RUN lines around it is all short
    short = lambda i: F.coalesce(F.get(F.col("__rules"), i)["short"], F.lit(False))
    window = lambda i: reduce(or_, (reduce(and_, (short(i + k) for k in range(first, first + RUN))) for first in range(1 - RUN, 1)))
    runs = F.transform("__rules", lambda x, i: F.struct(x["line"].alias("line"), (x["fails"] | window(i)).alias("fails")))
    plain = F.transform("__rules", lambda x: F.struct(x["line"].alias("line"), x["fails"].alias("fails")))
    docs = docs.withColumn("__judged", F.when(F.size(F.filter("__rules", lambda x: x["short"])) >= RUN, runs).otherwise(plain))
    docs = docs.withColumn("__texts", F.transform("__judged", lambda x: F.when(x["fails"].isNotNull(), x["line"])))
    repeated = F.size(F.array_distinct(F.filter("__texts", lambda x: x.isNotNull()))) < F.size(F.filter("__texts", lambda x: x.isNotNull()))
    docs = docs.withColumn("__repeated", repeated)
    # copies of a line stand side by side when sorted; all but the first fail; then back to the text's order
    by_line = F.sort_array(F.transform("__judged", lambda x, i: F.struct(x["line"].alias("line"), i.alias("i"), x["fails"].alias("fails"))))
    docs = docs.withColumn("__by_line", F.when(F.col("__repeated"), by_line))
    copy = lambda x, j: x["fails"] | F.coalesce(F.get(F.col("__by_line"), j - 1)["line"] == x["line"], F.lit(False))
    mark = F.sort_array(F.transform("__by_line", lambda x, j: F.struct(x["i"].alias("i"), x["line"].alias("line"), copy(x, j).alias("fails"))))
    mark = F.transform(mark, lambda x: F.struct(x["line"].alias("line"), x["fails"].alias("fails")))
    return docs.withColumn("__lines", F.when(F.col("__repeated"), mark).otherwise(F.col("__judged")))


def _counts(docs: DataFrame) -> DataFrame:
    """Adds the base counts of whole texts; needs __texts of ``_with_lines``."""
    docs = docs.withColumn("__words", split_words(F.coalesce("text", F.lit(""))))
    docs = docs.withColumn("__n", F.size("__words"))
    at = lambda i: F.get(F.col("__words"), i)
    window = F.transform(F.sequence(F.lit(0), F.col("__n") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    docs = docs.withColumn("__windows", F.when(F.col("__n") >= 3, window))
    # only texts with a repeated window are sorted: equal windows then stand side by side
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    docs = docs.withColumn("__sorted", F.when(some, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i: F.get(F.col("__sorted"), i)["h"]
    twice = F.filter("__sorted", lambda x, i: F.coalesce(near(i - 1) == x["h"], F.lit(False)) | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    docs = docs.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("last"))
    covered = F.aggregate("__starts", zero, lambda a, i: F.struct((a["covered"] + F.least(F.lit(3), i - a["last"])).alias("covered"), i.alias("last")), lambda a: a["covered"])
    real = F.filter("__texts", lambda x: x.isNotNull())
    return docs.withColumns(
        {
            "n_words": F.col("__n").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": F.when(F.col("__repeated"), F.size(real) - F.size(F.array_distinct(real))).otherwise(0).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )


def judge(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_share, kept, clean_text, and the columns in ``carry``."""
    scored = _counts(_with_lines(docs.select("doc_id", "text", *carry)))
    size = lambda wanted: F.aggregate(F.filter("__lines", wanted), F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    scored = scored.withColumns({"__lost": size(lambda x: x["fails"]), "__all": size(lambda x: x["fails"].isNotNull())})
    scored = scored.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
            "lost_share": F.when(F.col("__all") > 0, F.col("__lost") / F.col("__all")).otherwise(F.lit(1.0)),
            "clean_text": F.array_join(F.transform(F.filter("__lines", lambda x: ~F.coalesce(x["fails"], F.lit(False))), lambda x: x["line"]), "\n"),
        }
    )
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOST))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept", "clean_text", *carry)


def clean_lines(docs: DataFrame) -> DataFrame:
    """The documents kept, their failing lines removed; the columns of ``docs`` (n_chars follows the text, if there is one)."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    judged = judge(whole, ("__doc",))
    # a verdict that isn't deterministic for the optimiser is not pushed below the columns that it is made of, to be computed anew there
    judged = judged.withColumn("__stays", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    kept = judged.filter("__stays")
    return replace_text(kept.select("__doc", F.col("clean_text").alias("__text")), docs)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM x),
p AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS q FROM h WHERE c > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM w),
m AS (SELECT r, k, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
i AS (SELECT *, len(lw) <= {SHORT} AND NOT regexp_matches(line, '{_sql(ENDED)}') AS short FROM m),
j AS (SELECT *, CASE WHEN short THEN k - row_number() OVER (PARTITION BY r, short ORDER BY k) END AS island FROM i),
g AS (SELECT *, count(*) OVER (PARTITION BY r, island) AS run FROM j),
f AS (SELECT r, length(line) AS size, nth,
    nth > 1 OR len(regexp_extract_all(line, '{SYMBOL}')) > {SYMBOLS_PER_WORD}::DOUBLE * len(lw)
    OR len(regexp_extract_all(line, '{CAPITAL}')) > {CAPITALS_PER_CHAR}::DOUBLE * length(array_to_string(lw, ''))
    OR (len(lw) >= {LONG_LINE} AND len(list_distinct(lw)) < (1::DOUBLE / 3) * len(lw))
    OR regexp_matches(line, '{_sql(BOILERPLATE)}') OR regexp_matches(line, '{_sql(NAVIGATION)}')
    OR (len(lw) >= {SENTENCE} AND NOT regexp_matches(line, '{_sql(ENDED)}')) OR regexp_matches(line, '{_sql(TEASER)}')
    OR (len(regexp_extract_all(line, '{SEPARATOR}')) >= {SEPARATORS} AND len(lw) <= {WORDS_PER_SEPARATOR} * len(regexp_extract_all(line, '{SEPARATOR}')))
    OR (regexp_matches(line, '{LINK}') AND length(array_to_string(regexp_extract_all(line, '{LINK}'), '')) > {LINK_SHARE}::DOUBLE * length(array_to_string(lw, '')))
    OR (short AND run >= {RUN}) AS fails FROM g),
s AS (SELECT r, count(*) FILTER (WHERE nth > 1) AS dups, sum(size) FILTER (WHERE fails) AS lost, sum(size) AS total FROM f GROUP BY r),
t AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '{SYMBOL}')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CASE WHEN total > 0 THEN coalesce(lost, 0)::DOUBLE / total::DOUBLE ELSE 1.0::DOUBLE END AS lost_share
    FROM w LEFT JOIN p USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND lost_share <= {MAX_LOST} AS kept, lost_share
FROM t
"""
