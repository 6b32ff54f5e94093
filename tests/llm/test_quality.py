from collections import Counter

from seriesmill.llm import quality as Q
from tests.llm.conftest import WORD

SYMBOLS = set("#*$%&|<>")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def verdict(text):
    words, chars, symbols, dup, repeat = measured(text)
    failed = words < 20 or 100 * repeat > 30 * words
    lines = (text or "").split("\n")
    filled = [x.strip("\x20\t\n\x0b\x0c\r") for x in lines if WORD.search(x)]
    marks = sum(c.isascii() and c.isprintable() and not c.isalpha() and c != " " for c in text or "")
    top = max(Counter(WORD.findall(text or "")).values(), default=0)
    cut, listed = sum(x.endswith(("...", "…")) for x in filled), sum(x[0] in "-*•" for x in filled)
    own = 2 * marks > chars or 10 * top > 3 * words or (len(filled) > 2 and (10 * cut > 3 * len(filled) or 10 * listed > 9 * len(filled)))
    return failed, not (failed or 10 * symbols > chars or chars > 40 * words or chars < 2 * words or 2 * dup > len(lines) or own)


MORE = ["a b c d e f g h a b c d e f g h", "x\n\nx\n x\n" * 9, "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9", "| # " * 30, "w\n" * 40, ("p q r s t u v w " * 3 + "unlike ") * 4, "日本 語é " * 25]
PLAIN = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}rd" for k in range(60)).split()
MORE += [" ".join(PLAIN), "\n".join(" ".join(PLAIN[k : k + 10]) + ("... \r" if k < 20 else "") for k in range(0, 60, 10)), "\n".join(" ".join(PLAIN[k : k + 10]) + "…" for k in range(0, 60, 10))]
MORE += ["\n".join(" - " + " ".join(PLAIN[k : k + 10]) for k in range(0, 60, 10)), "- " + " ".join(PLAIN), " ".join(f"{w} the" for w in PLAIN), " ".join(f"{w} the end" if k % 2 else w for k, w in enumerate(PLAIN))]
MORE += [" ".join(f"{w}[12],\\`~" for w in PLAIN), " ".join(f"{w}[1]" for w in PLAIN)]


def test_measures_equal_brute_force(spark, docs, rows):
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(MORE)], "doc_id long, text string")
    got = Q.judge(docs.select("doc_id", "text").unionByName(extra)).collect()
    want = [(r[0], *measured(r[1]), *verdict(r[1])) for r in rows] + [(1000 + k, *measured(t), *verdict(t)) for k, t in enumerate(MORE)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_order_never_changes_the_verdict(docs, rows):
    rules = Q.default_rules()
    kept = []
    for order in (rules, rules[::-1]):
        kept.append(sorted(r["doc_id"] for r in docs.filter("doc_id IS NOT NULL").filter(Q.cascade(order).isNull()).collect()))
    assert kept[0] == kept[1] == sorted(r[0] for r in rows if r[0] is not None and verdict(r[1])[1])
    out = Q.filter_quality(docs)
    assert out.columns == docs.columns and out.filter("doc_id < 60").count() == len([i for i in kept[0] if i < 60])


def test_rules_that_reject_come_first(docs):
    from pyspark.sql import functions as F

    rules = [Q.Rule("never", F.length("text") < 0), Q.Rule("all", F.lit(True))]
    assert [r.name for r in Q.order_rules(docs, rules)] == ["all", "never"]


def test_no_python_in_the_plan(docs):
    plan = Q.judge(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(nothing):
    assert Q.judge(nothing).collect() == []


def test_a_rejected_text_runs_no_later_rule(spark, docs):
    """The later rule raises wherever it runs: on texts that the first one lets pass, and only there."""
    import pytest
    from pyspark.sql import functions as F

    short = Q.Rule("short", F.length(F.coalesce("text", F.lit(""))) < 200)
    later = Q.Rule("later", F.when(F.rand() < 2, F.raise_error(F.lit("later rule ran")).cast("boolean")))
    some = docs.filter("coalesce(length(text), 0) < 200")
    assert {r[0] for r in some.select(Q.cascade([short, later]).alias("name")).collect()} == {"short"}
    for order, frame in (([later, short], some), ([short, later], docs)):
        with pytest.raises(Exception, match="later rule ran"):
            frame.select(Q.cascade(order).alias("name")).collect()


def test_the_sample_is_spread_over_the_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    drawn = []
    frame = spark.range(0, 20_000, 1, 8).select(F.col("id"), F.lit("same text").alias("text"))
    Q.order_rules(frame, [], 200, lambda rows: drawn.append([r["id"] for r in rows.collect()]) or rows)
    assert len(drawn[0]) == 200 and {i // 2500 for i in drawn[0]} == set(range(8))
