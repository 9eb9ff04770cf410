from panelloom.llm import secrets
from tests.llm.data import docs
from tests.llm.test_secrets import HARD, rows, want


def test_two_increments_share_a_ledger(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read() is None
    assert rows(secrets.report_increments(docs(spark, HARD), ledger)) == want(HARD)
    seen = ledger.read()
    assert seen.count() == seen.select("blob").distinct().count() == 6
    # a third run has nothing new to scan
    findings, fresh = secrets.scan_versions(docs(spark, HARD), path="doc_id", ledger=ledger.read())
    assert fresh.count() == 0 and findings.count() == len(HARD)
    secrets.scan_increment(docs(spark, [(99, "token=newsecret1")]), ledger, path="doc_id")
    assert ledger.read().count() == 7


def test_other_rules_do_not_read_old_findings(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    table = docs(spark, [(1, "token=abcdef1 2024")])
    assert {s.kind for r in secrets.scan_increment(table, ledger, path="doc_id").collect() for s in r.spans} == {"assign"}
    digits = (secrets.Rule("digits", "[0-9]{4}"),)
    assert secrets.version_of(digits) != secrets.version_of(secrets.RULES)
    assert {s.kind for r in secrets.scan_increment(table, ledger, path="doc_id", rules=digits).collect() for s in r.spans} == {"digits"}
    assert secrets.redact(table, ledger=ledger, rules=digits).first().text == "token=abcdef1 [REDACTED]"


def test_pairs_appended_twice_count_once(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    _, fresh = secrets.scan_versions(docs(spark, HARD), path="doc_id")
    ledger.append(fresh)
    ledger.append(fresh)
    assert rows(secrets.report(docs(spark, HARD), ledger=ledger.read())) == want(HARD)


def test_many_copies_and_clashing_names(spark):
    t = [(i, "password=hunter22") for i in range(500)] + HARD
    d = docs(spark, t).selectExpr("*", "'b' as _blob", "1 as _spans", "2 as _redacted", "3 as blob", "4 as n")
    assert rows(secrets.report(d)) == want(t)
    got = secrets.redact(d)
    assert got.columns == d.columns
    back = got.collect()
    assert len(back) == len(t) and all((r._blob, r._spans, r._redacted, r.blob, r.n) == ("b", 1, 2, 3, 4) for r in back)
    assert sum(r.text == "[REDACTED]" for r in back) == 500
    assert secrets.redact(docs(spark, [])).collect() == []
