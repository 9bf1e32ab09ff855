"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the hash of its content. The ledger holds, for each blob and version of the
rules, what was found in it; only blobs that the ledger lacks for the current rules are scanned, once each, and findings
are joined back to all documents that have the blob. Everything is built-in column functions: the gaps between a
pattern's matches, added up, give the matches' places."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm._common import aside, read, restored, shared_dir

#: Kind, pattern, the group whose length counts, and the least length. What matches but is too short is passed over, and dropped.
RULES = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 35),  # a run is tried once, so a long one takes linear time
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]
BASE = ("assign", "access", "hex")
RULE_VERSION = 2
SPANS = "array<struct<start: bigint, rule: int, kind: string, end: bigint>>"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def address(docs: DataFrame) -> DataFrame:
    """Add blob, the content address of the text (null counts as empty)."""
    return docs.withColumn("blob", F.unhex(F.sha2(_text().cast("binary"), 256)))


def scan(blobs: DataFrame) -> DataFrame:
    """Findings of blobs(blob, text), whose blobs are distinct: blob and spans, by start and then in the order of the rules; places in
    code points, ends exclusive. Blobs without findings have no row."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    hits = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
        gaps = F.slice(F.split("text", pattern, -1), 1, F.size(whole))
        found = F.arrays_zip(lengths(gaps).alias("gap"), lengths(whole).alias("whole"), lengths(value).alias("value"))
        hits.append(F.when(F.col("text").rlike(pattern), F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), found.alias("found"))))
    by_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    rows = by_rule.select("blob", "h.rule", "h.kind", "h.least", F.posexplode("h.found").alias("at", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("at")
    ended = rows.withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.whole")).over(upto))
    span = F.struct((F.col("end") - F.col("m.whole")).alias("start"), "rule", "kind", "end")
    return ended.filter(F.col("m.value") >= F.col("least")).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULE_VERSION) -> DataFrame:
    """New rows of the ledger (blob, version, spans) for documents(doc_id, text): of each blob that has none for this version. A blob
    without findings has an empty array; an empty table gives no row. Texts of other versions of a document, and of documents that repeat, are scanned once."""
    docs = address(docs.select("doc_id", "text"))
    unseen = docs.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("version") == version), "blob", "left_anti")
    same = (docs["blob"] == unseen["blob"]) & docs["doc_id"].eqNullSafe(unseen["doc_id"])
    texts = docs.join(unseen, same, "left_semi").select("blob", _text().alias("text"))
    found = scan(texts.filter(F.col("text").rlike("|".join(f"(?:{p})" for _, p, _, _ in RULES))).dropDuplicates(["blob"]))
    return unseen.join(found, "blob", "left").select("blob", F.lit(version).alias("version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def stored_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at a path; None if nothing is there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def extend_ledger(docs: DataFrame, path: str | None = None, version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger stored at the path lacks, append it there, and return the whole ledger. An empty table appends no row.

    Without a path it is the one that spark.framelake.secretLedger names, which lasts from run to run; where that isn't set, a new one in
    the shared folder. Spark's commit makes an append whole or void, and a blob that two runs add at once counts once."""
    spark = docs.sparkSession
    path = path or spark.conf.get("spark.framelake.secretLedger", None) or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    update_ledger(docs, stored_ledger(spark, path), version).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, version: int = RULE_VERSION) -> DataFrame:
    """Join the ledger's findings to every document of documents(text, ...) that has the blob: adds blob and spans. A null text counts as
    an empty one, an empty table gives an empty result; other columns pass through, but for those named like a result."""
    known = ledger.filter((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    found = address(aside(docs, "text")).join(known, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return restored(found, docs.columns)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents(text, spans, ...) with each run of touching or overlapping spans replaced by the mark; the spans go."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        ahead = F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        new = (x["start"] > s["at"]) | (s["at"] == 0)
        out = F.when(new, F.concat(s["out"], F.when(x["start"] > s["at"], ahead).otherwise(""), F.lit(mark))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.lit(1 << 30))))
    return docs.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text"))).drop("spans", "blob")


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, from the stored ledger, or one that starts empty."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = findings(docs, extend_ledger(docs)).drop("text")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(n, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
