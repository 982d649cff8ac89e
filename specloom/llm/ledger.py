"""Secrets in every version of every document, through a ledger of what was scanned before.

A version's text is a blob, named by its SHA-256. The ledger holds, blob by blob, which versions of
which rules have read it and what they found. A scan reads only pairs of blob and rule version that
the ledger lacks, however many documents or versions share the blob, adds one finished batch to the
ledger, and joins its findings back to all documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWEST, Rows, scratch, staged


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost, non-overlapping matches are findings if group ``of`` has ``least`` characters.

    ``hints`` are lower-case words, one of which every match holds in any case. A new ``version``
    makes every blob unseen for this rule alone.
    """

    name: str
    pattern: str
    least: int = 0
    of: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        return lambda text: [m.span() for m in found.finditer(text) if m.end(self.of) - m.start(self.of) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    # a run of fewer than 24 fails as a whole, so only runs of 24 need to match at all
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Kinds beside the base ones: private key blocks, signed web tokens, and tokens that name their issuer.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key",)),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", hints=("eyj",)),
    Rule("issued", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|glpat-[A-Za-z0-9_-]{20,})", hints=("gh", "xox", "glpat")),
)
RULES = BASE + ADDED
FINDINGS = "array<struct<rule: string, start: bigint, end: bigint>>"


class Ledger:
    """Batches of scanned blobs under one path of a shared store: blob, rules, found.

    A batch is a folder that Spark's committer marks finished, so a scan that was cut off counts as
    never made. Two scans at once may both read a blob; their equal entries are taken once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        folders = [f.getPath() for f in store.listStatus(root) if f.isDirectory()]
        return sorted(str(f) for f in folders if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def read(self) -> DataFrame:
        schema = f"blob binary, rules array<string>, found {FINDINGS}"
        done = self.batches()
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def append(self, entries: DataFrame) -> None:
        entries.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, text: null text as empty, the blob its SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))


SCANNED = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def reader(rules: Sequence[Rule], known: int = 1 << 14):
    """Scans texts by the rules due for their blob; a blob met lately in the task is not read again."""

    def run(batches: Iterable[pa.RecordBatch]):
        out, finders, met = Rows(SCANNED), [(r, r.finder()) for r in rules], set()
        for batch in batches:
            blobs, due = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("blob", "due"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for j, blob in enumerate(blobs):
                if blob in met:
                    continue
                if len(met) == known:
                    met.clear()
                met.add(blob)
                text, wanted = texts[j].as_py(), set(due[j])
                low, found = text.lower(), []
                for rule, spans in finders:
                    if rule.key in wanted and (not rule.hints or any(h in low for h in rule.hints)):
                        found += [{"rule": rule.key, "start": a, "end": b} for a, b in spans(text)]
                yield from out.add(blob, due[j], found, weight=64 + 48 * len(found))
        yield from out.flush()

    return run


def scan(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans of every row, after adding to the ledger what it lacked.

    Spans (kind, start, end in code points, end exclusive) stand by start, then kind as listed; kinds
    may overlap. Rows stay one by one: versions with one id, null ids and repeated rows too; texts
    that are equal are read once by each rule version. Null text is empty, and an empty one has no
    finding; a text of any length is read whole. An empty table gives no row. Other columns are not read.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need different names")
    every = F.array(*(F.lit(r.key) for r in rules))
    paths = staged(addressed(docs, id_col, text_col).drop("text"), "paths")
    one = F.coalesce("doc_id", F.lit(LOWEST))
    seen = ledger.read().select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.key for r in rules]))
    seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one entry a rule
    blobs = paths.groupBy("blob").agg(F.min(one).alias("one")).join(seen, "blob", "left")
    due = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    # tables, so that joins can split a blob that many rows share
    unseen = staged(blobs.select("blob", "one", due.alias("due")).where(F.size("due") > 0), "unseen-blobs")
    # the text comes from one document of each unseen blob; copies under other ids never meet
    work = addressed(docs, id_col, text_col).withColumn("one", one).join(unseen, ["blob", "one"]).select("blob", "due", "text")
    ledger.append(work.mapInArrow(reader(rules), f"blob binary, rules array<string>, found {FINDINGS}"))

    names, order = (F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, (r.name, i)[w]))) for w in (0, 1))
    current = F.filter("found", lambda s: F.array_contains(every, s["rule"]))
    placed = F.transform(current, lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("order"), s["end"].alias("end"), names[s["rule"]].alias("kind")))
    entries = ledger.read().join(paths.select("blob").distinct(), "blob", "left_semi")
    found = entries.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(placed)))).alias("spans"))  # an entry a batch that read the blob
    return paths.join(staged(found, "findings"), "blob", "left").select("doc_id", "blob", "spans")


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.name) for r in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def fresh_ledger(spark: SparkSession) -> Ledger:
    """A ledger that goes with the session."""
    return Ledger(spark, scratch(spark, "ledger"))
