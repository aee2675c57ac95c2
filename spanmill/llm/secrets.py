"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob named by its SHA-256. A ledger holds the
blobs scanned so far for each rule version and what was found; a scan takes
only pairs of blob and rule version that the ledger lacks, one path for each,
and findings are joined back to every path that has the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import durable

#: Raised whenever a rule below changes: blobs are then scanned anew.
RULE_VERSION = "1"
#: kind, pattern, group whose length counts, least length. Fixed by the contract of the base spans.
BASE_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
)
#: Rules of this module's own, whose spans are added to the base ones.
MORE_RULES = (
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
)
RULES = BASE_RULES + MORE_RULES
#: Spans that a scan copies at a time.
BLOCK = 256
#: Cheap tests that a text must pass before its matches are located.
HINTS = {"assign": "[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "pem": "PRIVATE KEY-----", "jwt": r"[A-Za-z0-9_-]\.eyJ[A-Za-z0-9_-]{8}"}
#: Up to so many rows that needn't be scanned are broadcast.
BROADCAST_ROWS = 250_000
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def locate(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of one rule as spans in code points.

    The texts between matches and the matches themselves alternate, so running
    sums of their lengths are the offsets; no position function is needed.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("match"), F.transform(value, F.length).alias("value")
    )
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("open"), F.array().cast(f"array<array<{SPAN}>>").alias("full"))

    def step(state: Column, m: Column) -> Column:
        """Good spans gather in blocks, so that a text of very many matches copies few references for each."""
        start = state["at"] + m["gap"]
        end = start + m["match"]
        span = F.array(F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end")))
        good, ends = m["value"] >= least, F.size(state["open"]) >= BLOCK
        return F.struct(
            end.cast("bigint").alias("at"),
            F.when(good & ends, span).when(good, F.concat(state["open"], span)).otherwise(state["open"]).alias("open"),
            F.when(good & ends, F.concat(state["full"], F.array(state["open"]))).otherwise(state["full"]).alias("full"),
        )

    return F.aggregate(sizes, none, step, lambda a: F.flatten(F.concat(a["full"], F.array(a["open"]))))


def find_spans(text: Column) -> Column:
    """All spans of a text, by start and then in the order of ``RULES``."""
    empty = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(text.rlike(HINTS[kind]), locate(text, rank, kind, pattern, group, least)).otherwise(empty)
        for rank, (kind, pattern, group, least) in enumerate(RULES)
    ]
    return F.array_sort(F.concat(*found))


def scan(paths: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: ``(id, blob, spans)`` for each row of ``paths``, and the ledger after the scan.

    ``ledger`` has ``(blob, version, spans)``; None or an empty one means that
    everything is new. A null text is the empty text. Rows of equal texts are
    one blob, scanned once, by the row of least id (rows that repeat id and text
    are scanned each); a blob that the ledger has for ``version`` isn't scanned.
    Two versions under one id, or under none, are two blobs. Other columns aren't read; an empty table
    gives empty results.

    What needn't be scanned is counted: as few rows as ``BROADCAST_ROWS`` are
    broadcast, so that no text is shuffled; more meet the texts in a join on id and blob.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = paths.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    blobs = durable(texts.select("id", "blob"), "blobs")
    unseen = blobs.groupBy("blob").agg(F.min("id").alias("first"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    known = blobs.join(unseen.withColumn("new", F.lit(True)), "blob", "left").where(F.col("new").isNull() | ~F.col("id").eqNullSafe(F.col("first")))
    known = durable(known.select(F.col("id").alias("other"), F.col("blob").alias("of")).distinct(), "known")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    scanned = texts.join(known, (texts["blob"] == known["of"]) & texts["id"].eqNullSafe(known["other"]), "left_anti")
    scanned = scanned.select("blob", F.lit(version).alias("version"), find_spans(F.col("text")).alias("spans"))
    fresh = durable(scanned.dropDuplicates(["blob"]), "ledger")
    after = fresh if ledger is None else ledger.unionByName(fresh)
    known = after.where(F.col("version") == version).select("blob", "spans").where(F.size("spans") > 0)
    findings = blobs.join(known, "blob", "left").select("id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    return findings, after


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
