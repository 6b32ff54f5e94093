import hashlib
import re
import time

from seriesmill.llm import secrets as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
MORE = [
    "é password: abcdef1 secret=token:abcdef", "AKIA" + "A" * 20 + " AKIAAKIA" + "B" * 12, "a" * 24 + "g" + "b" * 23 + "🙂" + "0" * 40,
    "API_KEY='xyz123' apikey=\"qq\" Token  :  abc.def== toKen=\tx", "ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi12.eyJzdWIiOi12.abcdefgh1 x",
    "passwd=short passwd=longer1", "ſecret=abcdef toKen=abcdef", "secret=secret=abcdefg",
]


def base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_equal_brute_force(spark, docs, rows):
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(MORE)], "doc_id long, text string")
    findings, _ = S.scan(docs.select("doc_id", "text").unionByName(extra))
    want = []
    for i, text in [(r[0], r[1]) for r in rows] + [(1000 + k, t) for k, t in enumerate(MORE)]:
        found = base(text or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        want.append((i, *[sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    got = S.digest_spans(findings).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[1004] == "forge:0:44,hex:4:44,pem:45:76" and spans[1005].startswith("signed:0:")


def test_ledger_scans_only_unseen_pairs(spark, docs):
    first, ledger = S.scan(docs, S.BASE_RULES)
    blobs = docs.selectExpr("coalesce(text, '') AS t").distinct().count()
    assert ledger.count() == blobs
    # nothing new: no row is added, findings stay
    again, same = S.scan(docs, S.BASE_RULES, ledger)
    assert same.count() == blobs and sorted(map(repr, again.collect())) == sorted(map(repr, first.collect()))
    # one new text, one new rule: the new text takes all rules, the others the new rule only
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, "new secret = hunter22")], "doc_id long, text string"))
    rules = [*S.BASE_RULES, S.MORE_RULES[0]]
    findings, grown = S.scan(more, rules, ledger)
    sizes = sorted(len(r["rules"]) for r in grown.collect())
    assert sizes == [1] * blobs + [3] * blobs + [4]
    assert S.digest_spans(findings).filter("doc_id = 5000").first()["spans"] == "assign:4:21"
    # a rule that changed takes none of its old findings along
    stricter = [S.Rule("hex", "[0-9a-f]{64,}", "[0-9a-f]{64}", 0, 64)]
    findings, _ = S.scan(docs, stricter, ledger)
    assert findings.filter("size(spans) > 0").count() == 0


def test_time_follows_the_number_of_matches(spark):
    def run(n):
        text = " ".join(f"{k:024x}" for k in range(n)) + " token=abcdefgh"
        began = time.monotonic()
        row = S.digest_spans(S.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"))[0]).collect()[0]
        assert row["n_hex"] == n and row["n_assign"] == 1
        assert row["spans"].split(",")[-2:] == [f"hex:{25 * (n - 1)}:{25 * n - 1}", f"assign:{25 * n}:{25 * n + 14}"]
        return time.monotonic() - began

    run(10)
    # a hundred thousand matches in one text; summing from the start for each would take hours
    assert run(100_000) < 60


def test_empty_table(nothing):
    findings, ledger = S.scan(nothing)
    assert findings.collect() == [] and ledger.collect() == []


def test_no_python_in_the_plan(docs):
    plan = S.digest_spans(S.scan(docs)[0])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_the_query_scans_through_a_ledger(docs, monkeypatch):
    from seriesmill.llm import queries

    scan, ledgers = S.scan, []

    def watched(docs, rules=S.RULES, ledger=None, **how):
        findings, whole = scan(docs, rules, ledger, **how)
        ledgers.append(whole)
        return findings, whole

    want = sorted(map(tuple, S.digest_spans(scan(docs)[0]).collect()), key=repr)
    monkeypatch.setattr(S, "scan", watched)
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    assert sorted(map(tuple, queries.op8_secret_scan(docs.sparkSession, "").collect()), key=repr) == want
    base, more = ({r.version for r in rules} for rules in (S.BASE_RULES, S.MORE_RULES))
    first, both = ([(r["blob"], frozenset(r["rules"])) for r in ledger.collect()] for ledger in ledgers)
    assert {rules for _, rules in first} == {frozenset(base)}
    assert sorted(both, key=repr) == sorted(first + [(blob, frozenset(more)) for blob, _ in first], key=repr)
