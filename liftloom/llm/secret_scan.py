"""Secret scanning with an incremental blob ledger; DataFrame functions only.

Each text version is a *blob* named by its SHA-256.  The ledger holds the (blob, rule, version)
pairs that were scanned, so a blob that many paths share, or that an earlier run saw, is scanned
once per rule version.  Findings belong to blobs and are joined back to every path.

A blob that fails a rule's plain screen cannot match it and enters the ledger without its text
being moved; only suspicious blobs are shuffled, each once a run.

Defined cases: a null text is an empty blob.  Rows repeating id and text each get a row in the
result.  A null id is carried through.  Other columns are ignored.  Empty tables give no rows.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C


@dataclass(frozen=True)
class Rule:
    """A finding is a leftmost non-overlapping match of ``pattern`` whose group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    screen: str
    group: int = 0
    least: int = 1
    base: bool = False
    version: int = 1


# The base kinds in their order, then the kinds that this operator adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:passw|secret|token|api_?key)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", "[0-9a-f]{16}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ[A-Za-z0-9_-]{8}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("userinfo", r"://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", "://[^\\s:/@]{1,64}:"),
)
LEDGER = "blob string, kind string, version int"


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, text, blob)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def suspects(rule: Rule) -> Column:
    return F.col("text").rlike(rule.screen)


def scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, rank, s, e) of every finding in ``texts`` (blob, text, todo: the kinds to scan for; one row each)."""
    found = None
    for rank, rule in enumerate(rules):
        full = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        parts = F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
            F.transform(full, F.length).alias("len"),
            F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("val"),
        )
        rows = texts.where(F.array_contains("todo", rule.kind) & suspects(rule)).select("blob", F.posexplode(parts).alias("i", "m")).select("blob", "i", "m.*").where("len is not null")
        upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob").orderBy("i"))
        rows = rows.withColumn("e", upto).where(F.col("val") >= rule.least)
        rows = rows.select("blob", F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), (F.col("e") - F.col("len")).cast("long").alias("s"), F.col("e").cast("long"))
        found = rows if found is None else found.unionByName(rows)
    return found


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger) after scanning the unseen pairs of blob and rule version.

    ``ledger`` (blob, kind, version) and ``findings`` (blob, kind, rank, s, e) are those of earlier
    runs.  Each blob is scanned only for the rules whose version it was not scanned for; what earlier versions of those rules found in it goes.
    """
    spark = docs.sparkSession
    named = blobs(docs)
    pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    known = spark.range(1).select(F.inline(pairs))
    every = F.array(*(F.lit(r.kind) for r in rules))
    # Equal keys are combined before the shuffle, so a blob that many paths share moves once per task.
    todo = named.select("blob").distinct().withColumn("todo", every)
    if ledger is not None:
        seen = ledger.join(F.broadcast(known), ["kind", "version"]).groupBy("blob").agg(F.collect_set("kind").alias("seen"))  # at most one entry a rule
        todo = todo.join(seen, "blob", "left").select("blob", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = C.cut(todo.where(F.size("todo") > 0))
    any_rule = F.lit(False)
    for rule in rules:
        any_rule = any_rule | suspects(rule)
    texts = named.where(any_rule).groupBy("blob", "text").agg(F.count(F.lit(1)).alias("copies"))
    texts = C.cut(texts.join(todo, "blob"))
    fresh = C.cut(scan(texts, rules))
    paths = named.select("path", "blob")
    now = todo.select("blob", F.explode("todo").alias("kind")).join(F.broadcast(known), "kind").select("blob", "kind", "version")
    if ledger is not None:
        old = findings.join(now.select("blob", "kind"), ["blob", "kind"], "left_anti").select(fresh.columns)
        fresh, now = old.unionByName(fresh), ledger.unionByName(now).distinct()
    return paths, fresh, now


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The base rules are scanned for first; the run for all rules finds their pairs in the ledger and scans for the others only.
    """
    _, found, ledger = scan_ledger(docs, rules=tuple(r for r in rules if r.base))
    rank = {r.kind: k for k, r in enumerate(rules)}
    paths, found, _ = scan_ledger(docs, ledger, found, rules)
    found = found.withColumn("rank", F.create_map(*(F.lit(x) for item in rank.items() for x in item))[F.col("kind")])
    kinds = [r.kind for r in rules if r.base]

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: x["t"]))

    tag = F.struct("s", "rank", F.concat_ws(":", "kind", "s", "e").alias("t"))
    of_base = F.col("kind").isin(kinds)
    per_blob = found.groupBy("blob").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds),
        F.collect_list(F.when(of_base, tag)).alias("base"), F.collect_list(tag).alias("every"),
    )
    per_blob = per_blob.select("blob", *(f"n_{k}" for k in kinds), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))
    held = C.cut(paths)
    sizes = held.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    per_blob = C.cut(per_blob.join(sizes, "blob"))
    out = C.attach(held, per_blob, "blob", "copies", held.count())
    return out.select(F.col("path").alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
