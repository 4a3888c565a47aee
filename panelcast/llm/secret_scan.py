"""Secret scan with corpus-wide ownership frequency.

Three patterns give the base spans of a text. A wider pattern adds candidates:
long mixed strings of high entropy that no base span touches. Every candidate
value is hashed, and the corpus is asked in how many distinct repositories and
owners the hash occurs. A value of few owners that looks random is taken for a
live credential, one that many owners share for a copied example; an added span
is kept only if its value looks live.

Texts are read once; behind that only hashes and offsets move. Counts are
aggregated per task before the shuffle, and the join that brings them back is an
equi-join whose hot hashes adaptive execution splits.

Defined cases: a null or empty text has no spans; repeated rows are each
reported; a null repository or owner counts as one owner named null.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common

#: Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
WIDE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "wide")
#: Bits per character from which a value looks random; digits alone reach 3.3 at most.
LEAST_ENTROPY = 3.0
#: Owners from which a value is a copied example.
EXAMPLE_OWNERS = 4

SPANS = "array<struct<start:int,kind:int,end:int,hash:string,random:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return entropy(value) >= LEAST_ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base spans and added candidates, by start and kind."""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    starts, reach = [], []  # of the base spans by start: the furthest end so far
    for a, _, b, _ in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for m in WIDE.finditer(text):
        before = bisect_left(starts, m.end())
        if (not before or reach[before - 1] <= m.start()) and looks_random(m[0]):
            spans.append((m.start(), 3, m.end(), m[0]))
    return sorted(spans)


def candidates(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """A written table (row, doc_id, repo, owner, spans) of all rows; values are
    kept as hashes only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))
        for batch in batches:
            for part in common.by_bytes(batch):
                spans = [
                    [{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": looks_random(v)} for a, k, b, v in find(text)]
                    for text in common.strings(part.column("text")).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(spans)), pa.int64()), part.column("doc_id"), part.column("repo"), part.column("owner"), pa.array(spans, kind)],
                    names=["row", "doc_id", "repo", "owner", "spans"],
                )
                row += len(spans)

    columns = docs.select("doc_id", common.text_or_empty().alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"))
    return common.staged(common.map_arrow(columns, scan, f"row long, doc_id long, repo string, owner string, spans {SPANS}"), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, n_spans) over the whole corpus. Distinct (hash,
    owner, repository) triples are formed per task first, so a value that a third
    of all rows holds arrives as one row a task and owner."""
    values = found.select("repo", "owner", F.explode("spans.hash").alias("hash"))
    triples = values.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    owners = triples.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_spans"))


def scan_secrets(docs: DataFrame, repo: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Every row of ``docs (doc_id, text, ...)``: doc_id and its spans, an array of
    (start, kind, end, n_repos, n_owners, verdict) by start and kind, code points,
    end exclusive. ``verdict`` is ``example`` (at least ``example_owners`` owners
    hold the value), ``live`` (fewer, and it looks random) or ``weak``."""
    found = candidates(docs, repo, owner)
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("random"), "live").otherwise("weak")
    judged = spans.join(ownership(found), "hash").withColumn("verdict", verdict)
    kept = judged.filter((F.col("kind") < KINDS.index("wide")) | (F.col("verdict") == "live"))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners", "verdict"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,n_repos:long,n_owners:long,verdict:string>>")
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans, and how many
    spans look live or copied."""
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    with_verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("wide"))
    return scanned.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        of_kind(3).alias("n_added"), with_verdict("live").alias("n_live"), with_verdict("example").alias("n_example"),
    )
