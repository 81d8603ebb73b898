"""Secret scan over a trigram index.

Documents are indexed where they are: one pass over the bytes of each block of a
partition makes its postings (trigram -> rows of the block), of the trigrams
that the rules' queries name; the queries intersect and join them, and the
expressions run on the rows that are left.  A rule without mandatory trigrams runs on every row.  Nothing is
shuffled, and a block bounds the memory.

Matches are leftmost and do not overlap within a rule; a rule may drop matches
that are too short, and what a dropped match covers is not searched again.
Expressions take time in proportion to the text: what may come before a match
is ruled out by its last character (``after_no``), so that no run of characters
is entered at each of its places.

Defined results: a null or empty text has no spans; spans count code points,
end exclusive, and are ordered by start, then by the order of the rules;
repeated rows give repeated result rows; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import blocks
from .trigrams import Index, trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long ``group`` must be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII
    #: A class of characters that may not stand before a match.
    after_no: str = ""

    @property
    def expression(self) -> str:
        return f"(?<!{self.after_no}){self.pattern}" if self.after_no else self.pattern


#: Runs are greedy, so a run of 16 or more is found as such: shorter ones need no match.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", after_no="[A-Za-z0-9_-]"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    named = sorted(set().union(*map(trigrams, queries)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.expression, r.flags) for r in rules]
        for batch in blocks(batches):
            column = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
            index = Index(named, _bytes(column), ends)
            texts = column.to_pylist()
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for n, (rule, expression, query) in enumerate(zip(rules, compiled, queries)):
                for i in index.rows(query).tolist():
                    for m in expression.finditer(texts[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), n, m.end()))
            spans = [[{"kind": rules[n].kind, "start": a, "end": z} for a, n, z in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return of_batches


def _bytes(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts, one after another."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) of every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scan(rules), f"doc_id {kind}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a checksum of their spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
