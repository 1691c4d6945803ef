"""Secret scans with an incremental ledger of blobs.

Every text is addressed by its SHA-256.  The ledger holds the findings of each (blob, rule version)
scanned so far; a run scans one copy of each blob that the ledger lacks, and joins findings back to
all rows (paths, versions) with that content.  Addresses are counted first.  A Bloom filter of those
that the ledger has or that several rows share tells which rows are alone and new; these are scanned
where they are, and only the others' texts move, one a blob and task, to meet the exact list of
unseen blobs.  So a blob that fills a third of the table is scanned once.

Defined cases: null text counts as empty; repeated rows each get a row; null ids are kept; matches
that fail their kind's test are dropped without a second try, as the kinds' rules say; a text of any
length is scanned whole, in time that grows with its length; extra columns aren't looked at; an empty
table gives no rows and an empty ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import exists
from . import bloom
from .durable import written

BLOOM_BLOCKS = 1 << 17
RULE_VERSION = 2
#: The base kinds, in the order in which they are listed, then those that version 2 adds.
KINDS = ("assign", "access", "hex", "pem", "github", "slack", "jwt", "google")
BASE = 3
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of 24 or more: runs are maximal either way
_MORE = {
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "google": ("AIza", re.compile(r"\bAIza[0-9A-Za-z_-]{35}")),
}


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (mark, rule) in enumerate(_MORE.values(), BASE):
        if mark in text:
            found += [(m.start(), k, m.end()) for m in rule.finditer(text)]
    return sorted(found)


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
FINDINGS = T.StructType().add("blob", "binary").add("rule_version", "integer").add("findings", SPANS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t.as_py() or "")] for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("blob"), pa.array([RULE_VERSION] * b.num_rows, pa.int32()), pa.array(found, kind)], ["blob", "rule_version", "findings"]
        )


def _with_blob(versions: DataFrame) -> DataFrame:
    return versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def addressed(versions: DataFrame) -> DataFrame:
    """doc_id, blob: the address of each row's content."""
    return _with_blob(versions).select("doc_id", "blob")


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rule_version, findings) for the texts of ``versions`` (doc_id, text)."""
    rows = _with_blob(versions)
    counted = written(rows.groupBy("blob").agg(F.count(F.lit(1)).alias("rows")), "blobs")
    if ledger is None:
        unseen, held = counted, counted.where("rows > 1")
    else:
        known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").withColumn("known", F.lit(True))
        marked = written(counted.join(known, "blob", "left"), "marked")
        unseen, held = marked.where("known is null"), marked.where("known or rows > 1")
    held = held.select(F.col("blob").alias("listed"))
    count = held.count()
    alone = bloom.filtered(rows, "blob", held, "listed", count, BLOOM_BLOCKS, keep=False)
    others = bloom.filtered(rows, "blob", held, "listed", count, BLOOM_BLOCKS)
    if ledger is not None:  # what the ledger has needn't move
        others = bloom.filtered(others, "blob", unseen.select(F.col("blob").alias("listed")), "listed", unseen.count(), BLOOM_BLOCKS)
    once = others.groupBy("blob").agg(F.first("text").alias("text")).join(unseen.select("blob"), "blob", "left_semi")
    return alone.select("blob", "text").mapInArrow(_scan, FINDINGS).unionByName(once.mapInArrow(_scan, FINDINGS))


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger that earlier runs left at ``path``; None before the first."""
    return spark.read.schema(FINDINGS).parquet(path) if exists(spark, f"{path.rstrip('/')}/_SUCCESS") else None


def scan_into(versions: DataFrame, path: str) -> DataFrame:
    """Scans what the ledger at ``path`` lacks of ``versions`` (doc_id, text), adds it there, and returns what is new.

    The new rows are written before they are added, so a run that breaks off adds all of them or none, and the next one scans
    what is missing still; rows of other rule versions stay, and count for those who hold these rules.
    """
    spark = versions.sparkSession
    new = written(scan_unseen(versions, ledger_at(spark, path)), "ledger")
    new.write.mode("append").parquet(path)
    return new


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, blob, findings: the ledger's findings joined to all rows of ``paths`` (of addressed())."""
    known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "findings")
    return paths.select("doc_id", "blob").join(known, "blob")


def digest(found: DataFrame) -> DataFrame:
    """``found`` with the counts of the base kinds, base_sha256 and spans."""

    def joined(x):
        return F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(joined(of(*KINDS[:BASE])), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def content_address(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()
