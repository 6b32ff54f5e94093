"""URL filters: listed host and path rules, and association rules over URL tokens."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
#: Verdict and place (host, then path) of the listed rules.
LISTED = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
#: Share of the labelled URLs that a combination must be in, and share of blocked ones among them.
SUPPORT, CONFIDENCE = 0.005, 0.9
#: Labelled URLs that a combination must be in at least, however few there are.
LEAST_URLS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "verdict " + BLOCK


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def listed_rule(host: Column, path: Column, listed: Sequence[tuple[str, str]] = LISTED) -> Column:
    """Place and verdict of the longest listed rule that fits, NULL if none does.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, place in sorted(listed, key=lambda x: len(x[1])):
        name, slash, rest = place.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(place).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: all host suffixes, first host label, all path parts, file ending, query names.

    A run of digits in a path part counts as one ``#``, which no path has itself.
    """
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("host "), F.array_join(F.slice(labels, -n, n), ".")))
    suffixes = F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>"))
    first = F.when(F.size(labels) > 2, F.array(F.concat(F.lit("label "), F.get(labels, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.concat(F.lit("path "), x))
    ending = F.regexp_extract(path, "\\.([A-Za-z]{1,8})$", 1)
    ending = F.when(ending != "", F.array(F.concat(F.lit("ending "), ending))).otherwise(F.array().cast("array<string>"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query "), F.regexp_extract(x, "^([^=]*)", 1)))
    return F.array_distinct(F.concat(suffixes, first, parts, ending, names))


def fold_tokens(labelled: DataFrame, least: int) -> DataFrame:
    """``token`` and ``fold`` of all tokens in ``least`` labelled URLs or more; tokens of the same URLs share a fold, named by its smallest.

    A set of URLs is known by its size and two exclusive-or sums of row hashes.
    """
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens")
    names = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"z{k}") for k in (1, 2)]
    sets = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *names).filter(F.col("n") >= least)
    folds = sets.groupBy("n", "z1", "z2").agg(F.min("token").alias("fold"))
    return sets.join(folds, ["n", "z1", "z2"]).select("token", "fold", "n")


def to_folds(rows: DataFrame, folds: DataFrame, id_col: str) -> DataFrame:
    """``id_col`` and ``folds`` (distinct, sorted) of rows with any folded token; ``rows`` has ``tokens`` and unique ids."""
    posted = rows.select(id_col, F.explode("tokens").alias("token")).join(folds.select("token", "fold"), "token")
    return posted.groupBy(id_col).agg(F.array_sort(F.collect_set("fold")).alias("folds"))


def sure_enough(blocked: Column, all_urls: Column, base: Column) -> Column:
    """Whether so many blocked URLs could hardly come from the base rate: the lower end of a 95 % interval (Wilson) lies above it."""
    z = F.lit(1.6448536269514722)
    share = blocked / all_urls
    middle = share + z * z / (all_urls * 2)
    half = z * F.sqrt(share * (F.lit(1.0) - share) / all_urls + z * z / (all_urls * all_urls * 4))
    return (middle - half) / (F.lit(1.0) + z * z / all_urls) > base


def mine_folds(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules over folds (``antecedent``, ``key``, ``confidence``, ``support``) and the folds (:func:`fold_tokens`).

    ``labelled`` has ``tokens`` and ``blocked``; every labelled URL is a transaction,
    a blocked one with one more item.  Tokens that stand in the same URLs are one
    item, or a path of d parts would be 2^d combinations.  FP-growth gives the
    frequent combinations; those with the block item stay that imply it with at
    least ``confidence`` and surely more often than the base rate
    (:func:`sure_enough`), unless a part of the combination does so as surely.
    ``key`` is the rarest fold of the rule.  Without labelled URLs there is no rule.
    Runs jobs.
    """
    rows = cut_lineage(labelled.select("tokens", "blocked", F.monotonically_increasing_id().alias("row")))
    number, bad = rows.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    share = min(1.0, max(support, LEAST_URLS / max(1, number)))
    folds = cut_lineage(fold_tokens(rows, max(1, math.ceil(share * number - 1e-9))))
    folded = rows.select("row", "blocked").join(to_folds(rows, folds, "row"), "row", "left").withColumn("folds", F.coalesce("folds", F.array().cast("array<string>")))
    baskets = cut_lineage(folded.select(F.when(F.col("blocked"), F.concat("folds", F.array(F.lit(_LABEL)))).otherwise(F.col("folds")).alias("items")))
    frequent = FPGrowth(itemsCol="items", minSupport=share).fit(baskets).freqItemsets
    frequent = cut_lineage(frequent.select(F.array_sort("items").alias("items"), F.col("freq").cast("double").alias("freq")))
    blocked = frequent.filter(F.array_contains("items", _LABEL) & (F.size("items") > 1)).select(F.array_remove("items", _LABEL).alias("antecedent"), F.col("freq").alias("hits"))
    rules = blocked.join(frequent.withColumnsRenamed({"items": "antecedent", "freq": "all"}), "antecedent")
    rules = rules.filter((F.col("hits") >= F.col("all") * F.lit(confidence)) & sure_enough(F.col("hits"), F.col("all"), F.lit(bad / max(1, number))))
    rules = rules.select("antecedent", (F.col("hits") / F.col("all")).alias("confidence"), (F.col("hits") / F.lit(max(1, number))).alias("support"))
    single = folds.filter("token = fold").select(F.col("fold").alias("key"), "n")
    by_item = rules.select("antecedent", F.explode("antecedent").alias("key")).join(single, "key")
    rarest = by_item.groupBy("antecedent").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    keyed = cut_lineage(rules.join(rarest, "antecedent"))
    # a rule goes if a smaller one fits wherever it does and is as sure; the smaller one's key is among its folds
    inner = keyed.select("key", F.col("antecedent").alias("small"), F.col("confidence").alias("sure"))
    covered = keyed.select("antecedent", "confidence", F.explode("antecedent").alias("key")).join(inner, "key")
    covered = covered.filter((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence")))
    return keyed.join(covered.select("antecedent").distinct(), "antecedent", "left_anti"), folds


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``antecedent``, ``confidence`` and ``support`` of the smallest token combinations that mean blocking, written out.

    A rule of :func:`mine_folds` stands for one combination per choice of a token
    from each of its folds.
    """
    rules, folds = mine_folds(labelled, support, confidence)
    members = folds.groupBy("fold").agg(F.collect_list("token").alias("members"))
    parts = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", "confidence", "support", F.posexplode("antecedent").alias("pos", "fold"))
    lists = parts.join(members, "fold").groupBy("rule", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("pos", "members"))).alias("parts"))
    grown = F.aggregate("parts", F.array(F.array().cast("array<string>")), lambda out, part: F.flatten(F.transform(part["members"], lambda t: F.transform(out, lambda chosen: F.concat(chosen, F.array(t))))))
    return lists.select(F.explode(grown).alias("antecedent"), "confidence", "support").withColumn("antecedent", F.array_sort("antecedent"))


def matched(rows: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """``id_col`` of the rows whose ``folds`` hold all of a rule's, each once, found by an inverted index on the rules' keys."""
    posted = rows.select(id_col, "folds", F.explode("folds").alias("key"))
    hits = posted.join(rules.select("key", "antecedent"), "key")
    return hits.filter(F.size(F.array_except("antecedent", "folds")) == 0).select(id_col).distinct()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, listed: Sequence[tuple[str, str]] = LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (the listed rule that decides, or NULL) and ``verdict`` of every URL.

    Listed rules come first.  Elsewhere a URL is blocked if a mined rule matches and
    allowed if none does.  ``labels`` (columns ``url_col`` and ``blocked``) are what
    rules are mined from; without them the URLs that listed rules decide are the
    labels.  A NULL URL, or one without ``://``, has an empty host and path, no
    token, and is allowed.  Repeated rows and NULL identifiers keep their rows.
    Runs several jobs.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    rows = rows.withColumn("__found", listed_rule(F.col("host"), F.col("path"), listed))
    # URLs with the same tokens share a verdict: distinct token sets meet the rules, once each
    rows = cut_lineage(rows.withColumn("__set", F.xxhash64("tokens")))
    if labels is None:
        learned = rows.filter("__found IS NOT NULL").select("tokens", (F.col("__found.verdict") == BLOCK).alias("blocked"))
    else:
        learned = labels.filter(F.col("blocked").isNotNull()).select(url_tokens(F.col(url_col)).alias("tokens"), F.col("blocked").cast("boolean").alias("blocked"))
    rules, folds = mine_folds(learned, support, confidence)
    sets = rows.filter("__found IS NULL").groupBy("__set", "tokens").agg(F.lit(1))
    blocked = matched(to_folds(sets, folds, "__set"), rules, "__set").withColumn("__hit", F.lit(True))
    judged = rows.join(blocked, "__set", "left")
    verdict = F.coalesce(F.col("__found.verdict"), F.when(F.col("__hit"), BLOCK).otherwise(ALLOW))
    return judged.select(F.col("__id").alias(id_col), "host", "path", F.col("__found.rule").alias("rule"), verdict.alias("verdict"))
