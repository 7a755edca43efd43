"""Secret scans through an incremental blob ledger (native).

Every version of every path is named by the SHA-256 of its content. The ledger
is a table of (blob, scanned rule versions, findings); a run scans a blob only by
the rule versions that the ledger hasn't got for it, appends what it found, and
joins the findings of all its blobs back to all paths that hold them.

Spans are found with built-in functions alone: the pieces that ``split`` leaves
and the matches that ``regexp_extract_all`` returns alternate, so their lengths
add up to places in code points.

Defined results: a null text is the empty blob; repeated rows share a blob and get
equal results; other columns are ignored; an empty table gives an empty result
and an unchanged ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, heavy_keys, join_counted, new_path, row_key


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters; ``hint`` occurs in every match."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the contract.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)passw|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)

#: What the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27, "PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, r"eyJ"),
    Rule("host_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, r"xox[abprs]-"),
)

RULES = BASE + MORE

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's findings in ``text``, in order, as SPANS whose kind is the rule's name."""
    none = F.array().cast(SPANS)
    lengths = lambda x: F.transform(x, lambda y: F.length(y))
    facts = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias("n"),
        lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("own"),
    )
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
        F.when(
            x["own"] >= rule.least,
            F.array_append(acc["spans"], F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["n"]).alias("end"), F.lit(rule.name).alias("kind"))),
        ).otherwise(acc["spans"]).cast(SPANS).alias("spans"),
    )
    found = F.aggregate(facts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.hint), found).otherwise(none)


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """(doc_id, blob, spans) for every row; ``ledger`` is a folder that is read, appended to, and made if missing."""
    spark = docs.sparkSession
    known = None
    ledger = ledger or new_path(spark, "ledger")
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.parquet(ledger).groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))

    versions = F.array(*(F.lit(r.name) for r in rules))
    text = F.coalesce("text", F.lit(""))
    paths = checkpoint(docs.select("doc_id", row_key().alias("row_key"), F.sha2(text, 256).alias("blob")))
    blobs = paths.groupBy("blob").agg(F.min("row_key").alias("_row_key"), F.count("*").alias("n"))
    seen = F.array().cast("array<string>")
    if known is not None:
        blobs, seen = blobs.join(known, "blob", "left"), F.coalesce("seen", seen)
    blobs = checkpoint(blobs.withColumn("_missing", F.array_except(versions, seen)).select("blob", "_row_key", "n", "_missing"))

    # One row for each unseen blob; the texts of all other rows stay where they are. A blob that
    # one row holds is found by that row's key; of others a row is taken in each task, then one of all.
    unseen = blobs.filter(F.size("_missing") > 0).select("_row_key", "blob", "_missing", "n")
    often = heavy_keys(blobs)
    own = docs.select(row_key().alias("_row_key"), text.alias("_text"))
    alone, more = unseen.filter(F.col("n") == 1).drop("n").hint("shuffle_hash"), unseen.filter((F.col("n") > 1) & ~often).drop("n").hint("shuffle_hash")
    again = own.join(F.broadcast(unseen.filter((F.col("n") > 1) & often).drop("n")), "_row_key").unionByName(own.join(more, "_row_key"))
    texts = own.join(alone, "_row_key").unionByName(again.dropDuplicates(["_row_key"])).select("blob", "_missing", "_text")
    findings = F.flatten(F.array(*(F.when(F.array_contains("_missing", r.name), spans_of(F.col("_text"), r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules))))
    texts.select("blob", F.col("_missing").alias("scanned"), findings.alias("spans")).write.mode("append").parquet(ledger)

    own = spark.read.parquet(ledger).join(blobs.select("blob"), "blob", "left_semi").select("blob", "scanned", F.explode("spans").alias("x"))
    # Ledgers of before hold the bare kind; the row's own rule versions tell which one found it.
    named = F.when(F.contains("x.kind", F.lit("@")), F.col("x.kind")).otherwise(F.get(F.filter("scanned", lambda v: F.substring_index(v, "@", 1) == F.col("x.kind")), 0))
    # Ranks are those of the rules asked for, so another order of rules gives the same rows once.
    rank = F.array_position(versions, F.col("_name")).cast("int") - 1
    own = own.withColumn("_name", named).filter(F.array_contains(versions, F.col("_name"))).withColumn("x", F.struct(
        F.col("x.start").alias("start"), rank.alias("rank"), F.col("x.end").alias("end"), F.substring_index("_name", "@", 1).alias("kind")
    )).groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("spans"))
    members = checkpoint(blobs.select("blob", "n").join(own, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))))
    return join_counted(paths, members, "blob").select("doc_id", "blob", "spans")


def rendered(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    own = F.filter(spans, lambda x: x["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
