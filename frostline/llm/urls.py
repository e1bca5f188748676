"""URL filter: listed rules, and association rules mined from the URLs they judge.

Method: association-rule filtering. Spark's FP-growth mines combinations of
URL tokens and verdicts from labelled URLs; rules with enough support,
confidence and lift are kept and matched through an inverted index from token to rule.

Lists name hosts, so among the pages they judge the site (the host's last two labels) says where a list looked, not what was
found there, and is no token. Names before the site, folders and endings are.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.session import materialise

#: (verdict, rule): host, then the path's start; the host's subdomains count too.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="
#: Words of the names before the site that are tokens. A url has at most 6 + 3 + 1 tokens, so at most 1,023 combinations.
WORDS = 6
#: A token set with this part of the unlisted pages, or more, is common.
COMMON = 1_000


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def listed(host_: Column, path_: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, start = text.split("/", 1)
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _folded(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[0-9]+", "#")


def tokens(host_: Column, path_: Column) -> Column:
    """Words before the host's last two labels, the first two folders and the last, and the file's ending.

    Distinct, lower-case, digits folded to ``#``. Words are the parts between dots and hyphens, the WORDS nearest the site.
    """
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    names = F.when(n > 2, F.slice(labels, 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    words = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda x: F.split(_folded(x), "-"))), lambda x: x != ""))
    words = F.reverse(F.slice(F.reverse(words), 1, WORDS))
    parts = F.split(path_, "/")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    chosen = F.concat(F.slice(folders, 1, 2), F.when(F.size(folders) > 2, F.slice(folders, -1, 1)).otherwise(F.array().cast("array<string>")))
    ending = F.regexp_extract(path_, r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.array_distinct(F.concat(
        F.when(ending != "", F.array(F.concat(F.lit("ending="), _folded(ending)))).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("word="), x)),
        F.transform(chosen, lambda x: F.concat(F.lit("folder="), _folded(x))),
    ))


def mine(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.2, least: int = 20,
) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from rows (tokens, verdict).

    A rule holds for at least ``min_support`` of the rows and ``least`` of them, and is ``min_lift`` times as often right as its verdict is
    among all rows. Rules that name a superset of another rule's tokens with the same verdict
    and no more confidence are dropped. Without rows there are no rules.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    rows = max(labelled.count(), 1)
    # Half a row less: a share of whole rows is not lost by rounding.
    support = min(1.0, max(min_support, (least - 0.5) / rows))
    if rows < least:
        baskets = baskets.limit(0)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    says = F.element_at("consequent", 1)
    rules = (
        model.associationRules.where(says.startswith(_LABEL) & (F.col("lift") >= min_lift))
        .where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substring(says, len(_LABEL) + 1, 10).alias("verdict"), "confidence", "support",
        )
    )
    # A shorter rule that covers a longer one shares a token with it.
    short = rules.select(
        F.explode("tokens").alias("_token"), F.col("tokens").alias("_tokens"), F.col("verdict").alias("_verdict"),
        F.col("confidence").alias("_confidence"),
    )
    covers = (
        (F.size("_tokens") < F.size("tokens")) & (F.size(F.array_except("_tokens", "tokens")) == 0)
        & (F.col("_verdict") == F.col("verdict")) & (F.col("_confidence") >= F.col("confidence"))
    )
    long = rules.withColumn("_token", F.explode("tokens")).join(short, "_token").where(covers)
    kept = rules.join(long.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    return kept.withColumn("rule_id", F.xxhash64("tokens", "verdict"))


def match(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of the best rule whose tokens a page has all; no row where none fits.

    Pages with the same tokens are matched once. The inverted index is the
    rules by token; a rule fits when as many of its tokens are hit as it has.
    The surest rule wins, then the longer one, then block.
    """
    index = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("_n"), F.explode("tokens").alias("_token"))
    shapes = pages.select("tokens").distinct()
    hits = (
        shapes.withColumn("_token", F.explode("tokens")).join(index, "_token")
        .groupBy("tokens", "rule_id", "verdict", "confidence", "_n").agg(F.count(F.lit(1)).alias("_hits"))
        .where("_hits = _n")
    )
    rank = F.struct(F.round("confidence", 9).alias("c"), F.col("_n"), (F.col("verdict") == "block").cast("int").alias("b"), F.col("rule_id"))
    best = hits.groupBy("tokens").agg(F.max_by("verdict", rank).alias("mined"))
    return pages.select(key, "tokens").join(best, "tokens").select(key, "mined")


def described(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, the listed rule that fits and its verdict (null if none), and the url's tokens."""
    host_, path_ = host(F.coalesce("url", F.lit(""))), path(F.coalesce("url", F.lit("")))
    plain = pages.select("page_id", host_.alias("host"), path_.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    return plain.withColumns({"rule": rule, "listed": verdict, "tokens": tokens(F.col("host"), F.col("path"))})


def labels(seen: DataFrame) -> DataFrame:
    """Rows (tokens, verdict) of the pages that a list judges, to mine from."""
    return seen.where("rule is not null").select("tokens", F.col("listed").alias("verdict"))


def judge(
    pages: DataFrame, rules: tuple = RULES, min_support: float = 0.002, min_confidence: float = 0.8, default: str = "allow",
    min_lift: float = 1.2, least: int = 20, common: int = COMMON,
) -> DataFrame:
    """Verdict on every page's url: a listed rule's, else that of the mined rules, else the default.

    The URLs that listed rules judge are the labelled examples. Returns
    page_id, host, path, rule (null if none fits), verdict, and mined (whether a mined rule gave it), a row for each
    input row: repeated rows, null urls and null ids keep theirs. A null url or one without
    ``://`` has an empty host and path. Other columns of the input are ignored. An empty
    table gives an empty result; without labelled rows the default holds.
    """
    seen = described(pages, rules)
    open_ = seen.where("rule is null")
    total = open_.count()
    shapes = open_.groupBy("tokens").agg((F.count(F.lit(1)) * common >= total).alias("common"))
    fits = match(shapes.withColumn("_shape", F.col("tokens")), mine(labels(seen), min_support, min_confidence, min_lift, least), "_shape")
    found = materialise(shapes.join(fits.withColumnRenamed("_shape", "tokens"), "tokens", "left"), "mined")
    # Common token sets, ``common`` at most, are broadcast; their pages and the listed ones are spread over a join that has nothing for them.
    often = F.broadcast(found.where("common").select("tokens", "common", F.col("mined").alias("_often")))
    rare = found.where("not common").select(F.col("tokens").alias("_key"), F.col("mined").alias("_rare"))
    alone = F.array(F.lit(""), F.monotonically_increasing_id().cast("string"))
    keyed = seen.withColumn("_alone", alone).join(often, "tokens", "left").withColumn(
        "_key", F.when(F.col("rule").isNull() & F.col("common").isNull(), F.col("tokens")).otherwise(F.col("_alone"))
    )
    said = F.when(F.col("rule").isNull(), F.coalesce("_often", "_rare"))
    return keyed.join(rare, "_key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", said, F.lit(default)).alias("verdict"), said.isNotNull().alias("mined"),
    )


def agreement(pages: DataFrame, rules: tuple = RULES, folds: int = 5, **mining: float) -> DataFrame:
    """How mined rules judge listed pages they were not mined from: one row (pages, decided, agree).

    One of ``folds`` parts of the hosts and paths, by hash, is held out.
    """
    seen = described(pages, rules)
    held = F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == 0
    asked = seen.where("rule is not null").where(held).select(
        F.struct(F.monotonically_increasing_id().alias("n"), "listed").alias("page"), "tokens"
    )
    found = match(asked, mine(labels(seen.where(~held)), **mining), "page")
    return found.agg(F.count(F.lit(1)).alias("decided"), F.count_if(F.col("mined") == F.col("page.listed")).alias("agree")).crossJoin(
        F.broadcast(asked.agg(F.count(F.lit(1)).alias("pages")))
    ).select("pages", "decided", "agree")
