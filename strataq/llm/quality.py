"""Quality rules: divergence of a document's histograms from those of its language.

A document's characters fall into six classes and its words into the common
words of its language and the rest.  Both histograms are compared with the
language's references by the Jensen-Shannon distance (base 2, 0 to 1).  The
references are sums over all documents of that language which are long enough,
so they follow the corpus; a corpus of unlike languages is held apart by
``lang``.  Guards: a histogram judges only texts with enough words.

Everything is DataFrame functions.  One pass over the texts measures them and
writes the measures to the shared folder; from these, one aggregation to at most
five rows makes the references, which are literals of the verdicts.

Defined cases: a null text counts as empty; a null or unlisted ``lang`` is
judged by characters alone against the sums over all languages; a language of
which no document is long enough has no reference and judges nothing; repeated
rows are judged one by one; an empty table gives an empty result; other columns
pass through untouched, and working columns have names that start with
``__sq_`` and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._store import kept

# Twenty frequent words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as with was on be by are this or an".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par plus pas au sur".split(),
}
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_WORDS_FOR_COMMON = 100
MAX_CHAR_DISTANCE = 0.25
MAX_COMMON_DISTANCE = 0.28
CLASSES = ("lower", "upper", "digit", "space", "mark", "other")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once a row."""
    return F.transform(F.array(value), body)[0]


def _long(x: Column) -> Column:
    return x.cast("long")


def _gone(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _features(docs: DataFrame) -> DataFrame:
    """Adds the words, the character classes and the counts of common words."""
    rest = F.col("__sq_rest")
    lists = F.coalesce(*(F.when(F.col("__sq_lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()), F.array().cast("array<string>"))
    plain = F.transform("__sq_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    any_word = sorted({w for v in COMMON_WORDS.values() for w in v})
    return (
        docs.withColumn("__sq_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("__sq_lang", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("")))
        .withColumn("__sq_words", F.filter(F.split("__sq_text", WORD_BREAK), lambda w: w != ""))
        .withColumn("__sq_rest", F.regexp_replace("__sq_text", "\\p{L}+", ""))
        .withColumn("__sq_n", F.size("__sq_words"))
        .withColumn(
            "__sq_counts",
            _let(
                F.struct((F.length("__sq_text") - F.length(rest)).alias("letters"), _gone(F.col("__sq_text"), "\\p{Lu}+").alias("upper"), _gone(rest, "[0-9]+").alias("digit"), _gone(rest, WORD_BREAK).alias("space"), _gone(rest, "[.,;:?'\"()-]+").alias("mark"), F.length(rest).alias("rest")),
                lambda c: F.array(*map(_long, (c.letters - c.upper, c.upper, c.digit, c.space, c.mark, c.rest - c.digit - c.space - c.mark))),
            ),
        )
        .withColumn("__sq_hits", _let(F.filter(plain, lambda w: w.isin(*any_word)), lambda common: F.transform(lists, lambda x: _long(F.size(F.filter(common, lambda w: w == x))))))
    )


MEASURES = ("__sq_lang", "__sq_n", "__sq_counts", "__sq_hits", "__sq_word_chars", "__sq_symbols", "__sq_dup_lines", "__sq_repeats")


def measured(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (but for the columns ``without``) with ``MEASURES``."""
    lines = F.filter(F.split("__sq_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rest = F.col("__sq_rest")
    seen = (
        _features(docs)
        .withColumn("__sq_lines", lines)
        .withColumn("__sq_word_chars", F.length("__sq_text") - F.col("__sq_counts")[3])
        .withColumn("__sq_symbols", F.length(rest) - F.length(F.regexp_replace(rest, "[#*$%&|<>]+", "")))
        .withColumn("__sq_dup_lines", F.size("__sq_lines") - F.size(F.array_distinct("__sq_lines")))
        .withColumn("__sq_repeats", _repeats(F.col("__sq_words")))
    )
    return seen.select(*(c for c in docs.columns if c not in without), *MEASURES)


def fit_references(docs: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Character-class counts and common-word counts (others last) of each language; ``""`` is all languages. ``docs`` may be measured."""
    seen = (docs if "__sq_n" in docs.columns else _features(docs)).where(F.col("__sq_n") >= MIN_WORDS)
    width = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.col("__sq_counts")[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.get("__sq_hits", F.lit(k))).alias(f"w{k}") for k in range(width)]
    rows = seen.groupBy("__sq_lang").agg(F.sum("__sq_n").alias("n"), *sums).collect()  # five rows at most
    out, every = {}, [0] * len(CLASSES)
    for r in rows:
        chars = [r[f"c{k}"] for k in range(len(CLASSES))]
        every = [a + b for a, b in zip(every, chars)]
        if lang := r["__sq_lang"]:
            hits = [r[f"w{k}"] or 0 for k in range(len(COMMON_WORDS[lang]))]
            out[lang] = (chars, [*hits, r["n"] - sum(hits)])
    return out | {"": (every, [])} if rows else {}


def _distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of ``counts`` / ``total`` from the reference's shares."""
    whole = sum(reference)
    shares = F.array(*(F.lit(x / whole) for x in reference))

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / F.lit(2.0)
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(counts, shares, lambda c, q: term(c.cast("double") / total.cast("double"), q))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.lit(2.0), F.lit(0.0)))


def _repeats(words: Column) -> Column:
    """Number of words that stand in a window of three found twice or more."""

    def placed(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x.h) | (F.get(s, j + 1)["h"] == x.h))
        near = lambda hits: F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
        return F.size(near(_let(ordered, again)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    hashes = F.when(F.size(words) >= 3, windows).otherwise(F.array().cast("array<bigint>"))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(placed(h)))


def judge(docs: DataFrame, references: dict | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (but for the columns ``without``) with the base measures, both distances (null where a guard holds) and ``__sq_kept``."""
    seen, _ = kept(measured(docs, without), "quality-measures")
    references = fit_references(seen) if references is None else references
    n = F.col("__sq_n")
    chars = sum((F.col("__sq_counts")[k] for k in range(len(CLASSES))), F.lit(0))
    none = F.lit(None).cast("double")
    by_chars, by_words = none, none
    for lang, (c, w) in sorted(references.items()):
        here = F.col("__sq_lang") == lang
        if lang not in ("",):
            hits = F.concat(F.col("__sq_hits"), F.array(_long(n) - F.aggregate("__sq_hits", F.lit(0).cast("long"), lambda a, x: a + x)))
            by_words = F.when(here & (n >= MIN_WORDS_FOR_COMMON), _distance(hits, n, w)).otherwise(by_words)
        by_chars = F.when(here & (n >= MIN_WORDS), _distance(F.col("__sq_counts"), chars, c)).otherwise(by_chars)
    return (
        seen.withColumn("__sq_failed", (n < MIN_WORDS) | (F.lit(100) * F.col("__sq_repeats") > F.lit(MAX_REPEAT_PERCENT) * n))
        .withColumn("__sq_js_chars", by_chars)
        .withColumn("__sq_js_words", by_words)
        .withColumn("__sq_kept", ~F.col("__sq_failed") & (F.coalesce("__sq_js_chars", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("__sq_js_words", F.lit(0.0)) <= MAX_COMMON_DISTANCE))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return judge(docs).where("__sq_kept").select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' measures and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, without=("text",)).select(
        "doc_id", _long(F.col("__sq_n")).alias("n_words"), _long(F.col("__sq_word_chars")).alias("word_chars"), _long(F.col("__sq_symbols")).alias("n_symbols"),
        _long(F.col("__sq_dup_lines")).alias("n_dup_lines"), _long(F.col("__sq_repeats")).alias("n_repeat_words"), F.col("__sq_failed").alias("base_failed"), F.col("__sq_kept").alias("kept"),
    )


def _sql() -> str:
    """The query in DuckDB's SQL."""
    gone = lambda t, p: f"(length({t}) - length(regexp_replace({t}, '{p}', '', 'g')))"
    brk = "[ \\t-\\r]+"
    mark = "[.,;:?''\"()-]+"
    lists = " ".join(f"WHEN '{k}' THEN {v}" for k, v in COMMON_WORDS.items())
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    distance = lambda p, q: (
        f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "
        "(CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2.0)) ELSE 0.0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2.0)) ELSE 0.0 END))) / 2.0, 0.0))"
    )
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE '' END AS lang FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{brk}'), lambda x: x <> '') AS w, regexp_replace(t, '\\p{{L}}+', '', 'g') AS r,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM t
), c AS (
  SELECT *, len(w) AS n, {gone("t", chr(92) + "p{Lu}+")} AS upper, length(t) - length(r) AS letters, {gone("r", "[0-9]+")} AS digit, {gone("r", brk)} AS space,
    {gone("r", mark)} AS mark, list_filter(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))), lambda x: x IN ({", ".join(f"'{x}'" for x in every)})) AS common FROM w
), f AS (
  SELECT *, [letters - upper, upper, digit, space, mark, length(r) - digit - space - mark]::DOUBLE[] AS cc,
    list_transform(CASE lang {lists} ELSE []::VARCHAR[] END, lambda x: len(list_filter(common, lambda y: y = x))) AS h FROM c
), refs AS (
  SELECT lang, sum(n) AS n, {", ".join(f"sum(cc[{k + 1}]) AS c{k}" for k in range(6))}, {", ".join(f"sum(h[{k + 1}]) AS w{k}" for k in range(20))} FROM f WHERE n >= {MIN_WORDS} GROUP BY lang
), ref AS (
  SELECT lang, [c0, c1, c2, c3, c4, c5] AS c, [{", ".join(f"w{k}" for k in range(20))}, n - ({" + ".join(f"w{k}" for k in range(20))})]::DOUBLE[] AS h FROM refs WHERE lang <> ''
  UNION ALL SELECT '', [sum(c0), sum(c1), sum(c2), sum(c3), sum(c4), sum(c5)], NULL FROM refs HAVING count(*) > 0
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), d AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1) GROUP BY rid
), s AS (
  SELECT f.*, coalesce(d.n, 0) AS again,
    CASE WHEN f.n >= {MIN_WORDS} THEN {distance("list_transform(f.cc, lambda x: x / list_sum(f.cc))", "list_transform(ref.c, lambda x: x / list_sum(ref.c))")} END AS jc,
    CASE WHEN f.n >= {MIN_WORDS_FOR_COMMON} AND ref.h IS NOT NULL THEN {distance("list_transform(list_append(f.h, f.n - list_sum(f.h)), lambda x: x::DOUBLE / f.n)", "list_transform(ref.h, lambda x: x / list_sum(ref.h))")} END AS jw
  FROM f LEFT JOIN d USING (rid) LEFT JOIN ref ON ref.lang = f.lang
)
SELECT doc_id, n::BIGINT AS n_words, (length(t) - space)::BIGINT AS word_chars, {gone("t", "[#*$%&|<>]+")}::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  again::BIGINT AS n_repeat_words, (n < {MIN_WORDS} OR 100 * again > {MAX_REPEAT_PERCENT} * n) AS base_failed,
  (NOT (n < {MIN_WORDS} OR 100 * again > {MAX_REPEAT_PERCENT} * n) AND coalesce(jc, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(jw, 0) <= {MAX_COMMON_DISTANCE}) AS kept
FROM s"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL = {"op5_quality_rules": _sql()}
