"""Secret scans with an incremental ledger of blobs, in SQL functions only.

Every version of a text is addressed by the SHA-256 of its content.  A ledger
records which blobs have been scanned under which version of the rules; only
pairs that it lacks are scanned, once however many paths share the blob, and
findings are joined back to all paths.  The version is a digest of the rules
themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.store import exists, free_name, materialize


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (Java syntax), leftmost and non-overlapping.

    ``group`` must have ``least`` characters or more; a match that fails this
    is dropped after it has taken its characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which kinds are listed.  A run of at least n of a class is
#: what remains of all runs when those that are shorter are dropped.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + EXTRA_RULES
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
REDACTED = "[REDACTED]"
#: Blobs of more than one in so many rows are joined by broadcast, if they have
#: no more than so many spans.
HEAVY, HEAVY_SPANS = 256, 4096


def version_of(rules: tuple[Rule, ...]) -> str:
    """The rules' version: a digest of all that they say, in their order."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


class Ledger:
    """``blob, rules_version, spans`` of all that was scanned, in a folder that only grows.

    It is partitioned by version, so that older rules' findings are not read.
    Appends are whole or absent, so a run that failed is repeated; a pair that
    two runs append both counts once when it is read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        if not exists(self.spark, self.path):
            return None
        return self.spark.read.schema(f"blob string, spans {SPAN}, rules_version string").parquet(self.path)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("blob", "rules_version", "spans").write.mode("append").partitionBy("rules_version").parquet(self.path)


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """Matches of one rule with their places in code points, end exclusive.

    The pieces between matches give the places: each match starts after all
    pieces and matches before it.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))).cast(SPAN)
        if rule.group:
            one = F.when(F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least, one).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    # the last piece has no match after it
    zipped = F.filter(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), lambda x: x["match"].isNotNull())
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules by start, then by the rules' order."""
    return F.array_sort(F.concat(*[_spans(text, i, r) for i, r in enumerate(rules)]))


def blob(text: Column) -> Column:
    """The address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _with_spans(rows: DataFrame, key: str, found: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``rows`` left-joined to ``found`` (blob, spans) by blob.

    Copies of one text would all go to one task: the blobs of more than one in
    ``HEAVY`` rows, of which there are no more than that, are broadcast; the
    few of more than ``HEAVY_SPANS`` spans are left to AQE.
    """
    large = found.where(F.size("spans" if "spans" in found.columns else found.columns[-1]) > HEAVY_SPANS).select("blob")
    many = counts.where(F.col("n") > max(HEAVY // 4, total // HEAVY)).select("blob").join(large, "blob", "left_anti")
    heavy = F.broadcast(found.join(F.broadcast(many), "blob", "left_semi"))
    light = found.join(F.broadcast(many), "blob", "left_anti")
    is_heavy = rows.join(F.broadcast(many).withColumnRenamed("blob", key), key, "left_semi")
    rest = rows.join(F.broadcast(many).withColumnRenamed("blob", key), key, "left_anti")
    first = is_heavy.join(heavy.withColumnRenamed("blob", key), key, "left")
    return first.unionByName(rest.join(light.withColumnRenamed("blob", key), key, "left"))


def _scanned(source: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], version: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Of ``path, text``: paths with blobs, their numbers, all spans found, the new ones, rows."""
    index = materialize(source.select("path", blob(F.col("text")).alias("blob")), "blobs")
    counts = materialize(index.groupBy("blob").agg(F.min("path").alias("chosen"), F.count("*").alias("n")), "counts")
    wanted, known = counts, None
    if ledger is not None:
        mine = ledger.where(F.col("rules_version") == version).join(counts.select("blob"), "blob", "left_semi")
        known = materialize(mine.groupBy("blob").agg(F.first("spans").alias("spans")), "known")
        wanted = wanted.join(known, "blob", "left_anti")
    address = source.withColumn("address", blob(F.col("text")))
    unseen = address.join(wanted, (F.col("address") == F.col("blob")) & F.col("path").eqNullSafe(F.col("chosen")))
    scanned = unseen.select("blob", find_spans(F.col("text"), rules).alias("spans")).dropDuplicates(["blob"])
    fresh = materialize(scanned.select("blob", F.lit(version).alias("rules_version"), "spans"), "ledger")
    found = fresh.select("blob", "spans")
    if known is not None:
        found = found.unionByName(known)
    return index, counts, found.where(F.size("spans") > 0), fresh, index.count()


def scan_versions(versions: DataFrame, *, path: str = "path", text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rules_version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions`` and the rows to append to the ledger.

    Findings have ``path, blob, spans``, one row per row of ``versions``;
    null and empty texts have no spans, paths may be null or repeated, other
    columns are left out.  Ledger rows have ``blob, rules_version, spans``, one
    per pair that was not in ``ledger`` (none is an empty ledger).  The version
    is that of the rules unless another is named.

    Addresses and findings are small tables, written once; texts move in one
    shuffle, on (blob, path), so that copies of a text spread evenly, and only
    one row per blob is left to scan.
    """
    source = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    index, counts, found, fresh, total = _scanned(source, ledger, rules, rules_version or version_of(rules))
    findings = _with_spans(index, "blob", found, counts, total)
    return findings.select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), fresh


def scan_increment(versions: DataFrame, ledger: Ledger, *, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``versions``; what the ledger lacked is scanned and appended to it."""
    findings, fresh = scan_versions(versions, path=path, text=text, ledger=ledger.read(), rules=rules)
    ledger.append(fresh)
    return findings


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _reported(findings: DataFrame) -> DataFrame:
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    return findings.select(F.col("path").alias("doc_id"), number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans of each row; rows as in :func:`scan_versions`."""
    findings, _ = scan_versions(docs, path=id_col, text=text_col, ledger=ledger)
    return _reported(findings)


def report_increments(docs: DataFrame, ledger: Ledger, *, id_col: str = "doc_id", text_col: str = "text", increments: int = 2) -> DataFrame:
    """:func:`report` of all rows, which reach the ledger in increments.

    The rows are dealt by a hash of the id; each increment but the last scans
    its own part, the last all rows, of which only texts that no part before
    had are new.
    """
    for k in range(increments - 1):
        scan_increment(docs.where(F.pmod(F.xxhash64(id_col), F.lit(increments)) == k), ledger, path=id_col, text=text_col)
    return _reported(scan_increment(docs, ledger, path=id_col, text=text_col))


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced."""

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, F.lit(REDACTED))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, all rows and columns kept, with secrets replaced in the text.

    ``length_col`` is brought up to date where a text changed, if present.
    Null texts stay null, null and repeated ids are told apart by their texts
    alone, runs of overlapping spans become one replacement, an empty table
    stays empty and columns may have any names.  What ``ledger`` lacks is
    scanned and appended to it.
    """
    source = docs.select(F.col(id_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    _, counts, found, fresh, total = _scanned(source, ledger.read() if ledger else None, rules, version_of(rules))
    if ledger:
        ledger.append(fresh)
    key, spans, redacted = (free_name(docs, x) for x in ("_blob", "_spans", "_redacted"))
    out = _with_spans(docs.withColumn(key, blob(F.col(text_col))), key, found.withColumnRenamed("spans", spans), counts, total)
    # under a name of its own: an alias "text" would be seen by the lambdas beside it
    out = out.withColumn(redacted, F.when(F.col(spans).isNotNull(), _redacted(F.col(text_col), F.col(spans))))
    changed = {text_col: F.coalesce(redacted, text_col)}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col(redacted).isNull(), F.col(length_col)).otherwise(F.length(redacted).cast(docs.schema[length_col].dataType))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
