"""URL verdicts from rules and, where none fits, from segmented names.

Concatenated names in hosts and paths are split into words by the Viterbi
algorithm over a unigram model, whose counts cover all words of the visible
text of all pages; the words are then scored by multinomial naive Bayes.  The
pages that a rule decides are the classifier's training set, all of them, so it
carries the rules over to hosts that no rule names.

No vocabulary is cut and none is sent to tasks: of the model's words a name
needs only those that stand in it, so the substrings of all distinct names are
joined with the counts, and each distinct name is split by itself.  Tokens,
their odds and names are joined likewise; what reaches the driver is a few
sums.  Words and pieces are of letters of any script; a word has ``LONGEST``
letters at most, which is part of the model.  Markup, its attributes, scripts
and styles are not visible text.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and no tokens, and gets the verdict of the class shares; with no page
decided by a rule the verdict is "allow", as on ties; repeated rows are judged
one by one; a name of any length is split whole, in time by its length; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._store import drop, kept

# Host, path and verdict of each rule.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LONGEST = 64
SMOOTHING = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def visible(html: Column) -> Column:
    """The text without tags, scripts and styles."""
    chunks = F.split(html, "(?i)<(?=(?:script|style)\\b)")

    def rest(c: Column, i: Column) -> Column:
        low = F.lower(c)
        end = F.when(low.startswith("script"), F.locate("</script", low)).otherwise(F.locate("</style", low))
        return F.when(i == 0, c).when(end > 0, F.substr(c, end)).otherwise("")

    return F.regexp_replace(F.array_join(F.transform(chunks, rest), " "), "<[^<>]*>", " ")


def unigrams(texts: DataFrame, column: str) -> DataFrame:
    """w and n: the counts of all words in all rows."""
    words = texts.select(F.explode(F.split(F.lower(visible(F.col(column))), "[^\\p{L}]+")).alias("w")).where((F.length("w") > 0) & (F.length("w") <= LONGEST))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def pieces(host: Column, path: Column) -> Column:
    """The runs of letters and of digits in order, lower-cased; digits as ``#`` and their number."""
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", host, path)), F.lit("([0-9]+|\\p{L}+)"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("#"), F.least(F.length(x), F.lit(LONGEST)).cast("string"))).otherwise(x))


class Segmenter:
    """Splits a name into the likeliest sequence of words; of equally likely ones, that whose last words are longest."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        whole = math.log(max(1, sum(counts.values()) if total is None else total))
        self.cost = {w: whole - math.log(n) for w, n in counts.items()}
        self.unknown = [whole + k * math.log(10) - math.log(10) for k in range(LONGEST + 1)]

    def price(self, word: str) -> float:
        return self.cost.get(word, self.unknown[len(word)])

    def __call__(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            costs = [(best[at] + self.price(name[at:end]), at) for at in range(max(0, end - LONGEST), end)]
            cost, at = min(costs)
            best.append(cost)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        out.reverse()
        return out

    def tokens(self, name: str) -> list[str]:
        """The words of a name; unknown pieces stand by their lengths."""
        return [w if w in self.cost else f"?{len(w)}" for w in self(name)]


def _splitting(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for name, words in zip(batch.column("name").to_pylist(), batch.column("words").to_pylist()):
                tokens.append([name] if name[0] == "#" else Segmenter({x["w"]: x["n"] for x in words or ()}, total).tokens(name))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(tokens, pa.list_(pa.string()))], ["name", "tokens"])

    return run


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name and tokens of each distinct name. ``counts`` has w and n."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda at: F.substr(F.col("name"), at, F.lit(LONGEST)))
    prefixes = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda n: F.substr(x, F.lit(1), n))
    parts = names.where(~F.col("name").startswith("#")).select("name", F.explode(F.array_distinct(F.flatten(F.transform(starts, prefixes)))).alias("w"))
    found = parts.join(counts, "w").groupBy("name").agg(F.collect_list(F.struct("w", "n")).alias("words"))  # LONGEST times a name's length at most
    return names.join(found, "name", "left").mapInArrow(_splitting(total), "name string, tokens array<string>")


def odds_of(tokens: DataFrame) -> tuple[DataFrame, float]:
    """token and odds (log odds of "block" by multinomial naive Bayes with additive smoothing), and the odds of a token that no page of a rule has. ``tokens`` has verdict, token and n."""
    of = lambda verdict: F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col("n"))), F.lit(0))
    counted = tokens.groupBy("token").agg(of("allow").alias("allow"), of("block").alias("block"))
    sums = counted.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("tokens")).first()
    if not sums["tokens"]:
        return counted.select("token", F.lit(0.0).alias("odds")), 0.0
    size = {c: sums[c] + SMOOTHING * (sums["tokens"] + 1) for c in ("allow", "block")}
    new = math.log(SMOOTHING / size["block"]) - math.log(SMOOTHING / size["allow"])
    return counted.select("token", (F.log(F.col("block") + SMOOTHING) - F.log(F.col("allow") + SMOOTHING) + F.lit(new)).alias("odds")), new


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``key``, host, path, rule and verdict of every row; ``text`` is the column whose words the unigram model counts."""
    spark = pages.sparkSession
    parsed = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    parsed = parsed.select(key, "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    counts, at_counts = kept(unigrams(pages, text), "url-words")
    urls, at_urls = kept(parsed.groupBy("host", "path", "verdict").agg(F.count("*").alias("pages")), "url-distinct")
    classes = {r["verdict"]: r["n"] for r in urls.where("verdict is not null").groupBy("verdict").agg(F.sum("pages").alias("n")).collect()}  # two rows
    prior = math.log((classes.get("block", 0) + SMOOTHING) / (classes.get("allow", 0) + SMOOTHING)) if classes else 0.0
    named = urls.select("host", "path", "verdict", "pages", F.explode(pieces(F.col("host"), F.col("path"))).alias("name"))
    split, at_split = kept(split_names(named.select("name").distinct(), counts), "url-names")
    trained = named.where("verdict is not null").groupBy("verdict", "name").agg(F.sum("pages").alias("n")).join(split, "name")
    odds, new = odds_of(trained.select("verdict", F.explode("tokens").alias("token"), "n"))
    by_name = split.select("name", F.explode("tokens").alias("token")).join(odds, "token", "left").groupBy("name").agg(F.sum(F.coalesce("odds", F.lit(new))).alias("odds"))
    scored = named.where("verdict is null").join(by_name, "name").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    scored, _ = kept(scored, "url-odds")
    drop(spark, at_counts, at_urls, at_split)
    decided = parsed.where("verdict is not null")
    # urls without a name need no join; that of the others is by shuffle at any size, as the scores grow with the pages
    bare = (F.col("host") == "") & (F.col("path") == "")
    left = parsed.where("verdict is null")
    rest = left.where(~bare).join(scored.hint("merge"), ["host", "path"], "left").unionByName(left.where(bare).withColumn("odds", F.lit(0.0)))
    verdict = F.when(F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(prior), 9) > 0, "block").otherwise("allow")
    return decided.unionByName(rest.select(key, "host", "path", "rule", verdict.alias("verdict")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE_SQL: dict[str, str] = {}
