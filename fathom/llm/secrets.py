"""Incremental secret scanning over a content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger
keeps which (blob, rule version) pairs were scanned and what was found; a run
scans only pairs not seen before, one copy of each blob, records them, and
joins the findings of the current rules back to all paths that hold the blob.

Ledger layout under ``ledger_dir`` (all Parquet, append-only)::

    findings/run=<id>/   blob, rule_id, rule_version, ordinal, start_pos, end_pos, fingerprint
    scanned/run=<id>/    blob, rules (array of "rule_id@version")

Findings are published before the scanned entries, each by one rename, so a run
that dies scans again rather than forgetting; double findings are dropped on
reading. Matches themselves are never stored, only their SHA-256.

Defined results: a null text is no blob and has no findings, an empty text is a
blob without findings; repeated rows each get their findings; positions are in
code points, ``end_pos`` exclusive, ``ordinal`` counts from 1 within the blob
and rule. Output columns replace path columns of the same name; an empty table
gives no finding.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import arrow_map, delete_path, fresh_path, others, path_exists, quoted, rename


@dataclass(frozen=True)
class Rule:
    """A secret pattern. ``anchors``: the pattern can match only where one of these literals occurs."""

    rule_id: str
    version: int
    pattern: str
    anchors: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.rule_id}@{self.version}"


#: Patterns are written in the syntax Python's re (ASCII classes) and RE2 share.
RULES = (
    Rule("aws_access_key", 1, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google_api_key", 1, r"\bAIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("stripe_key", 1, r"\bsk_live_[0-9A-Za-z]{24,}\b", ("sk_live_",)),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("-----BEGIN ",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",)),
    Rule("assigned_secret", 1, r"(?i)\b(?:token|secret|password|passwd|api_key|apikey)\W{1,6}[\"'][^\"'\s]{8,}[\"']", ('"', "'")),
    Rule("hex_token", 1, r"\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b"),
)

FINDING = "rule_id string, rule_version int, ordinal int, start_pos int, end_pos int, fingerprint string"
_BLOB, _REP, _TODO, _HITS = "__blob", "__rep", "__todo", "__hits"


def scan_text(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[tuple]:
    """Findings of one blob under the given compiled rules."""
    out = []
    for rule, pattern in rules:
        if rule.anchors and not any(a in text for a in rule.anchors):
            continue
        for n, m in enumerate(pattern.finditer(text), 1):
            out.append((rule.rule_id, rule.version, n, m.start(), m.end(), hashlib.sha256(m[0].encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def blob_id(text_col: str):
    return F.unhex(F.sha2(F.col(quoted(text_col)), 256))


def update_ledger(docs: DataFrame, ledger_dir: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> str:
    """Scan what the ledger hasn't seen of ``docs``; returns the id of the run.

    What is shuffled to find the unseen blobs is hashes; the texts move once, to
    meet the unseen set, and not at all when that set is small enough for the
    optimizer to broadcast it (the usual incremental run).
    """
    spark = docs.sparkSession
    run = uuid.uuid4().hex
    keys = sorted(r.key for r in rules)
    texts = docs.select(F.col(quoted(text_col)).alias("text"), *[F.col(quoted(c)) for c in others(docs.columns, [text_col])])
    identity = F.xxhash64(*[F.col(quoted(c)).cast("string") for c in texts.columns[1:]]) if len(texts.columns) > 1 else F.lit(0).cast("long")
    texts = texts.filter(F.col("text").isNotNull()).select("text", blob_id("text").alias(_BLOB), identity.alias(_REP))
    # one representative of each blob is scanned
    todo = texts.groupBy(_BLOB).agg(F.min(_REP).alias(_REP))
    every = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    if path_exists(spark, f"{ledger_dir}/scanned"):
        seen = spark.read.parquet(f"{ledger_dir}/scanned").groupBy(F.col("blob").alias(_BLOB)).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = todo.join(seen, _BLOB, "left").withColumn(_TODO, F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
    else:
        todo = todo.withColumn(_TODO, every)
    pending = f"{ledger_dir}/pending/{run}"
    todo.filter(F.size(_TODO) > 0).write.parquet(pending)
    todo = spark.read.parquet(pending)

    found = _scan(texts.join(todo, [_BLOB, _REP]), rules)
    draft = f"{ledger_dir}/pending/{run}-findings"
    found.write.parquet(draft)
    rename(spark, draft, f"{ledger_dir}/findings/run={run}")
    scanned = f"{ledger_dir}/pending/{run}-scanned"
    todo.select(F.col(_BLOB).alias("blob"), F.col(_TODO).alias("rules")).write.parquet(scanned)
    rename(spark, scanned, f"{ledger_dir}/scanned/run={run}")
    delete_path(spark, pending)
    return run


def _scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    hits = f"array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in FINDING.split(', ')))}>>"
    field = blobs.sparkSession.createDataFrame([], f"{_HITS} {hits}").schema[0]
    arrow = pa.list_(pa.struct([("rule_id", pa.string()), ("rule_version", pa.int32()), ("ordinal", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("fingerprint", pa.string())]))
    names = [f.name for f in arrow.value_type]

    def make():
        compiled = {r.key: (r, re.compile(r.pattern, re.ASCII)) for r in rules}

        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            out, cache = [], {}
            for text, todo in zip(b.column(0), b.column(1).to_pylist()):
                picked = cache.setdefault(tuple(todo), [compiled[k] for k in todo])
                out.append([dict(zip(names, h)) for h in scan_text(text.as_py(), picked)] or None)
            return [pa.array(out, arrow)]

        return batch

    found = arrow_map(blobs, ["text", _TODO], [_BLOB], [field], make)
    return found.filter(F.col(_HITS).isNotNull()).select(F.col(_BLOB).alias("blob"), F.inline(_HITS))


def findings_by_blob(spark: SparkSession, ledger_dir: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All findings of the given rule versions in the ledger, each once."""
    current = spark.createDataFrame([(r.rule_id, r.version) for r in rules], "rule_id string, rule_version int")
    return spark.read.schema(f"blob binary, {FINDING}").parquet(f"{ledger_dir}/findings").drop("run").join(F.broadcast(current), ["rule_id", "rule_version"]).dropDuplicates(["blob", "rule_id", "rule_version", "ordinal"])


def scan_secrets(docs: DataFrame, ledger_dir: str | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text", path_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Findings of every path: path columns and FINDING columns.

    Without a ``ledger_dir`` the ledger starts empty in the shared folder.
    """
    spark = docs.sparkSession
    ledger_dir = ledger_dir or fresh_path(spark, "secret-ledger")
    update_ledger(docs, ledger_dir, rules, text_col)
    names = [x.split()[0] for x in FINDING.split(", ")]
    paths = docs.select(blob_id(text_col).alias("blob"), *[F.col(quoted(c)) for c in others(path_cols, [*names, "blob"])])
    return paths.join(findings_by_blob(spark, ledger_dir, rules), "blob").drop("blob")


def redact_secrets(docs: DataFrame, ledger_dir: str | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``<rule_id>``; all rows and columns stay.

    Where spans of several rules overlap, they are replaced as one, named after
    the rule of the leftmost (then longest) span. ``length_col``, if present,
    is set to the new length of rewritten texts.
    """
    spark = docs.sparkSession
    ledger_dir = ledger_dir or fresh_path(spark, "secret-ledger")
    update_ledger(docs, ledger_dir, rules, text_col)
    spans = findings_by_blob(spark, ledger_dir, rules).groupBy(F.col("blob").alias(_BLOB)).agg(F.sort_array(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("neg_end"), "rule_id"))).alias(_HITS))
    text = F.col(quoted(text_col))
    joined = docs.withColumn(_BLOB, blob_id(text_col)).join(spans, _BLOB, "left")

    def step(acc, s):
        end = -s["neg_end"]
        piece = F.substring(text, acc["pos"] + 1, s["start_pos"] - acc["pos"])
        return F.when(s["start_pos"] >= acc["pos"], F.struct(F.concat(acc["out"], piece, F.lit("<"), s["rule_id"], F.lit(">")).alias("out"), end.alias("pos"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["pos"], end).alias("pos"))
        )

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    clean = F.aggregate(_HITS, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.lit(2**31 - 1))))
    out = joined.withColumn("__new", F.when(F.col(_HITS).isNull(), text).otherwise(clean))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__new").alias(c))
        elif length_col and c == length_col:
            cols.append(F.when(F.col(_HITS).isNull(), F.col(quoted(c))).otherwise(F.length("__new").cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(quoted(c)))
    return out.select(*cols)


def oracle(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for the findings of all documents: the pieces between matches give the positions."""
    parts = []
    for r in rules:
        pat = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{r.rule_id}' AS rule_id, {r.version} AS rule_version, i AS ordinal,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, m[i] AS hit
FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{pat}') AS m, string_split_regex(text, '{pat}') AS p FROM documents WHERE regexp_matches(text, '{pat}')))"""
        )
    return f"""SELECT doc_id, rule_id, CAST(rule_version AS INTEGER) AS rule_version, CAST(ordinal AS INTEGER) AS ordinal, CAST(s AS INTEGER) AS start_pos,
  CAST(s + length(hit) AS INTEGER) AS end_pos, sha256(hit) AS fingerprint FROM ({' UNION ALL '.join(parts)})"""
