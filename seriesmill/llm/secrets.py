"""Secrets in texts, found by an incremental ledger of blobs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.session import cut_lineage


def either_case(word: str) -> str:
    """A pattern for a word with ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; those stay whose ``group`` has ``least`` characters or more.

    ``hint`` is a cheaper pattern that every text with a match has a match of.
    """

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """Changes whenever what the rule finds may change."""
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# The patterns of the kinds.
_NAMES = "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"), either_case("api") + "_?" + either_case("key")])
BASE_RULES = [
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", rf"({_NAMES})[\"']?\x20*[:=]", 2, 6),
    # a run of 20 or 24 characters is found whole, so the length can stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}", 0, 24),
]
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"\.eyJ"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
]
RULES = [*BASE_RULES, *MORE_RULES]

_SPANS = "array<struct<start:int,kind:string,end:int,rule:string>>"


def match_lengths(text: Column, rule: Rule) -> Column:
    """Per match, in order: the length of the text before it (from the last match on), its own and its group's; code points."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"), F.transform(inner, F.length).alias("inner"))
    return F.when(text.rlike(rule.hint), lengths)


def find_spans(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob`` and ``spans`` (start, kind, end exclusive in code points, rule version) of the texts that have any.

    ``texts`` has ``blob``, ``text`` and ``todo``, the rule versions to run; a blob may
    stand in it more than once.  Text between matches and the matches alternate, so
    a position is a running sum of lengths: matches become rows, and one window per
    blob and kind adds them up, in time proportional to the matches.
    """
    every = [F.struct(F.lit(k).alias("nth"), F.when(F.array_contains("todo", r.version), match_lengths(F.col("text"), r)).alias("lengths")) for k, r in enumerate(rules)]
    lists = texts.select("blob", F.inline(F.array(*every)))
    rows = lists.select("blob", "nth", F.posexplode("lengths").alias("pos", "l")).filter("l.size IS NOT NULL").select("blob", "nth", "pos", "l.*")
    # rows that repeat a text give the same matches; one deal serves both steps
    rows = rows.repartition("blob", "nth").dropDuplicates(["blob", "nth", "pos"])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "nth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("end", end.cast("int"))
    of_rule = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("nth") + 1)
    kept = placed.filter(F.col("inner") >= of_rule([r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), of_rule([r.kind for r in rules]).alias("kind"), "end", of_rule([r.version for r in rules]).alias("rule"))
    return kept.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _ordered(spans: Column, rules: Sequence[Rule]) -> Column:
    """Spans by start, then by kind as listed, as ``kind:start:end`` joined by commas."""
    rank = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every row and the ledger with what this scan added.

    The ledger has rows ``blob`` (SHA-256 of a text), ``rules`` (versions that have
    been run on it) and ``spans``; a blob may have several rows, from several scans.
    Each distinct text is a blob whatever rows, sources or versions of a document
    hold it.  Only pairs of blob and rule version that the ledger lacks are scanned,
    each once; then findings of all rules in use go back to every row of the blob.

    The findings have ``id_col``, ``blob`` and ``spans`` (array of start, kind,
    end and rule version).  NULL counts as the empty text, which is a blob without findings.
    Repeated rows and NULL identifiers keep their rows.  Runs a few jobs; only texts
    that match the hint of a rule which some blob lacks are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob")))
    versions = F.array(*[F.lit(r.version) for r in rules])
    blobs = rows.groupBy("blob").agg(F.min("id").alias("id"))
    if ledger is None:
        todo = blobs.withColumn("todo", versions)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0)
    todo = cut_lineage(todo.select(F.col("blob").alias("__blob"), F.col("id").alias("__id"), "todo"))
    lacking = {row[0] for row in todo.select(F.explode("todo")).distinct().collect()}  # one row per rule at most
    # a text without a match of any hint has no span: it need not meet its blob
    hinted = F.lit(False)
    for rule in rules:
        if rule.version in lacking:
            hinted = hinted | text.rlike(rule.hint)
    texts = docs.filter(hinted).select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    # texts stream past a hash table of digests; they are neither sorted nor gathered
    unseen = texts.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("__blob")) & F.col("id").eqNullSafe(F.col("__id")))
    spans = find_spans(unseen.select("blob", "text", "todo"), rules)
    scanned = todo.select(F.col("__blob").alias("blob"), F.col("todo").alias("rules"))
    added = cut_lineage(scanned.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS))))
    whole = added if ledger is None else ledger.select("blob", "rules", "spans").unionByName(added)
    if ledger is None:
        of_blob = added.select("blob", "spans")
    else:
        useful = whole.filter(F.arrays_overlap("rules", versions))
        of_blob = useful.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        of_blob = of_blob.withColumn("spans", F.filter("spans", lambda s: F.array_contains(versions, s["rule"])))
    placed = rows.join(of_blob.filter(F.size("spans") > 0), "blob", "left")
    return placed.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")), whole


def digest_spans(findings: DataFrame, id_col: str = "doc_id", base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id_col``, a count ``n_<kind>`` per base kind, ``base_sha256`` and ``spans`` as text."""
    kinds = F.array(*[F.lit(r.kind) for r in base])
    own = F.filter("spans", lambda s: F.array_contains(kinds, s["kind"]))
    counts = [F.size(F.filter("spans", _is_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in base]
    return findings.select(id_col, *counts, F.sha2(_ordered(own, rules), 256).alias("base_sha256"), _ordered(F.col("spans"), rules).alias("spans"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind
