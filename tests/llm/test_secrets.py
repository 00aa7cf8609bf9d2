import hashlib
import re

from fathom.llm import secrets
from fathom.llm.secrets import RULES, Rule, findings_by_blob, redact_secrets, scan_secrets, update_ledger
from fathom.llm.shared import fresh_path

KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
ROWS = [
    (1, "v1", f"x {KEY} y", "e"),
    (1, "v2", f"é🙂 {KEY} y {KEY}", "e"),
    (2, "v1", f"x {KEY} y", "e"),
    (2, "v1", f"x {KEY} y", "e"),
    (3, "v1", None, None),
    (4, "v1", "", "e"),
    (None, "v1", f'token = "{HEX}"', "e"),
    (5, "v1", "clean " * 50000 + HEX, "e"),
]
SCHEMA = "doc_id long, version string, text string, blob string"


def brute(rows):
    out = []
    for d, v, text, _ in rows:
        for r in RULES:
            for n, m in enumerate(re.finditer(r.pattern, text or "", re.ASCII), 1):
                out.append((d, v, r.rule_id, n, m.start(), m.end(), hashlib.sha256(m[0].encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.version, r.rule_id, r.ordinal, r.start_pos, r.end_pos, r.fingerprint) for r in df.collect()), key=str)


def test_all_paths(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = scan_secrets(df, path_cols=["doc_id", "version"])
    assert found(out) == brute(ROWS) and len(found(out)) == 8
    assert scan_secrets(df.limit(0)).count() == 0


def test_incremental(spark):
    ledger = fresh_path(spark, "ledger")
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = update_ledger(df, ledger)
    assert spark.read.parquet(f"{ledger}/scanned/run={first}").count() == 5  # distinct blobs, null apart
    more = [*ROWS, (9, "v9", f"x {KEY} y", "e"), (9, "v10", "new " + HEX, "e")]
    again = spark.createDataFrame(more, SCHEMA)
    second = update_ledger(again, ledger)
    assert spark.read.parquet(f"{ledger}/scanned/run={second}").count() == 1
    assert found(scan_secrets(again, ledger, path_cols=["doc_id", "version"])) == brute(more)
    # a new version of one rule: only that rule runs again, over all blobs
    rules = [*RULES[1:], Rule("aws_access_key", 2, RULES[0].pattern, RULES[0].anchors)]
    third = update_ledger(again, ledger, rules)
    rows = spark.read.parquet(f"{ledger}/scanned/run={third}").collect()
    assert len(rows) == 6 and all(r.rules == ["aws_access_key@2"] for r in rows)
    assert {r.rule_version for r in findings_by_blob(spark, ledger, rules).collect() if r.rule_id == "aws_access_key"} == {2}


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"é {KEY} y", 99), (2, None, 0), (3, "ok", 2), (4, f'a token = "{HEX}" b', 9)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in redact_secrets(df).collect()}
    assert got[1].text == "é <aws_access_key> y" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_chars == 0 and got[3].text == "ok"
    assert got[4].text == "a <assigned_secret> b"
    assert redact_secrets(df).schema == df.schema
    assert secrets.redact_secrets(df.limit(0)).count() == 0
