"""Hierarchical language identification.

First the family of languages is predicted, then, inside the family, linear
support vector machines vote between each two of its languages.  Features are
the frequencies of hashed character n-grams over letters (anything else counts
as a space), over the whole text.

The classifier is fitted on the driver from a bounded sample: ``SAMPLE``
labelled documents, shared evenly by all languages and at most ``per_language``
of each, of at most ``longest`` characters.  The bound is one of rows; any
number of languages is learned while each can have a row.  Prediction covers
every row and shuffles nothing.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without labelled rows every text is ``und``; with one language learned it is
always that language; a language outside the table of families is a family of
its own; ties go to the greater sum of margins, then to the first language by
name; repeated rows give repeated result rows; an empty table gives an empty
result.  Extra columns are carried in ``row`` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import give_back
from .linear import svm

#: Language codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNKNOWN = "und"
BUCKETS = 1 << 13
ORDERS = 3
#: Sampled documents in all, and of one language.
SAMPLE = 2_400
PER_LANGUAGE = 200
LONGEST = 20_000
#: Each sampled text is learned whole and by a part of so many characters.
PART = 120
#: Characters whose n-grams are scored at once; a worker holds some 50 bytes for each, and 4 for each machine.
_BLOCK = 1 << 17
#: How steeply a margin turns into a score.
_SLOPE = 3.0


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _codes(texts: list[str]) -> np.ndarray:
    """Letters of all texts, with spaces around each: ``ORDERS`` more than it has characters.

    Two spaces end a text, so no n-gram reaches into another.
    """
    return _letters()[np.frombuffer(f" {'   '.join(texts)}  ".encode("utf-32-le", "surrogatepass"), np.uint32)]


def _blocks(texts: list[str], size: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """The codes of whole texts (from, to), or of part of a long one, about ``_BLOCK`` at a time.

    A later part begins with the last characters of the one before, which n-grams
    reach back to; the third value counts them.
    """
    ends, lo = np.cumsum(size), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + _BLOCK, "right")))
        if size[lo] <= _BLOCK:
            yield lo, hi, 0, _codes(texts[lo:hi])
        else:
            for at in range(0, len(texts[lo]), _BLOCK):
                again = min(at, ORDERS - 1)
                codes = _codes([texts[lo][at - again : at + _BLOCK]])[at > 0 :]  # a space leads the first part, and two end the last
                yield lo, hi, again, codes if at + _BLOCK >= len(texts[lo]) else codes[: 1 - ORDERS]
        lo = hi


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that end at each character, by n."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        shifted = np.r_[np.full(n, 32, np.uint32), codes[: len(codes) - n]]
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def features(texts: list[str]) -> np.ndarray:
    """Frequencies of each text's n-grams, one row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        codes = _codes([text])
        for h in _grams(codes):
            out[i] += np.bincount(h, minlength=BUCKETS)
        out[i] /= len(codes)
    return out


@dataclass(frozen=True)
class Model:
    """Families with their languages; a column of ``weights`` for each machine."""

    families: tuple[tuple[str, ...], ...]
    machines: tuple[tuple[int, int, int], ...]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of every machine, and whether a text has a letter."""
        total, letters = np.zeros((len(texts), len(self.machines))), np.zeros(len(texts), bool)
        size = np.fromiter((len(x) + ORDERS for x in texts), np.int64, len(texts))
        for lo, hi, again, codes in _blocks(texts, size):
            at = np.cumsum(size[lo:hi]) - size[lo:hi]
            letters[lo:hi] |= np.add.reduceat(codes[again:] != 32, at, dtype=np.int64) > 0
            for h in _grams(codes):
                total[lo:hi] += np.add.reduceat(self.weights[h[again:]], at, axis=0, dtype=np.float64)
        return total / size[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins, letters = self.scores(texts)
        sure = 1 / (1 + np.exp(-_SLOPE * margins))
        n = len(self.families)
        columns = {m: i for i, m in enumerate(self.machines)}
        by_family = np.stack([margins[:, columns[-1, f, f]] for f in range(n)], 1) if n > 1 else np.zeros((len(texts), 1))
        family = by_family.argmax(1)
        score = sure[np.arange(len(texts)), [columns[-1, f, f] for f in family]] if n > 1 else np.ones(len(texts))
        names = np.full(len(texts), UNKNOWN, object)
        for f, langs in enumerate(self.families):
            here = np.flatnonzero(family == f)
            votes, margin, least = np.zeros((len(here), len(langs))), np.zeros((len(here), len(langs))), np.ones((len(here), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                i = columns[f, a, b]
                m, p = margins[here, i], sure[here, i]
                for lang, mm, pp in ((a, m, p), (b, -m, 1 - p)):
                    votes[:, lang] += mm > 0 if lang == a else mm >= 0
                    margin[:, lang] += mm
                    least[:, lang] = np.minimum(least[:, lang], pp)
            best = (votes + 0.5 * np.tanh(margin) / len(langs)).argmax(1)
            names[here] = np.array(langs, object)[best]
            score[here] *= least[np.arange(len(here)), best]
        names[~letters] = UNKNOWN
        return names.tolist(), np.where(letters, np.clip(score, 0.0, 1.0), 0.0)


#: For use where nothing could be learned: a text with a letter is in some language.
LETTERS = Model((("any",),), (), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))


def fit(texts: list[str], langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Fit all machines on labelled texts."""
    known = sorted(set(langs))
    if not known:
        return Model((), (), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    parts = [x[len(x) // 2 : len(x) // 2 + PART] for x in texts]
    texts, langs = texts + parts, langs + langs
    family_of = {lang: next((f for f, members in families.items() if lang in members), lang) for lang in known}
    groups = tuple(tuple(x for x in known if family_of[x] == f) for f in sorted(set(family_of.values())))
    x, labels = features(texts), np.array(langs)
    scale = 1 / np.sqrt(x.mean(0) + 1e-4)
    x *= scale
    x /= (size := float(np.sqrt((x * x).sum(1).mean())) or 1.0)
    # Machines of families are (-1, f, f); those of two languages (family, a, b).
    jobs = [((-1, f, f), np.ones(len(labels), bool), np.isin(labels, g)) for f, g in enumerate(groups)] if len(groups) > 1 else []
    jobs += [((f, a, b), np.isin(labels, (g[a], g[b])), labels == g[a]) for f, g in enumerate(groups) for a, b in combinations(range(len(g)), 2)]
    gram = x @ x.T + np.float32(1)  # the one is the bias
    weights, bias = np.zeros((BUCKETS, len(jobs)), np.float32), np.zeros(len(jobs))
    for i, (_, rows, yes) in enumerate(jobs):
        of = np.flatnonzero(rows)
        part = gram if len(of) == len(gram) else gram[np.ix_(of, of)]
        shares = np.zeros(len(gram), np.float32)
        shares[of] = svm(part, np.where(yes[of], 1.0, -1.0), cost=10.0)
        weights[:, i], bias[i] = (shares @ x) * scale / size, float(shares.sum(dtype=np.float64))
    return Model(groups, tuple(m for m, *_ in jobs), weights, bias)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model learns from: a quarter, by checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, longest: int = LONGEST, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    rows = rows.filter(F.length("text") <= longest)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not counts:
        return fit([], [])
    each = max(1, min(per_language, sample // len(counts)))
    # Keep rows by a hash of the id, so that about twice the sample is left, and of these the first by hash.
    order = F.xxhash64(F.lit(6), "id")
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, (2.0 * each + 8) / n)) for lang, n in counts], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").filter(F.pmod(order, F.lit(1_000_000_000)) <= F.col("share") * 1_000_000_000)
    first = Window.partitionBy("lang").orderBy(order, F.xxhash64("text"))
    taken = chosen.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= each).select("lang", "text").collect()
    taken.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in taken], [r["lang"] for r in taken])


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``, or all of ``docs``), ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), *([F.col(text_col).cast("string").alias("text")] if carry else []))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1) if carry else pc.struct_field(batch.column(0), text_col).cast(pa.string())
            at = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * _BLOCK, "right")) - 1)
                names, score = held.value.predict([x or "" for x in text.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])
                lo = hi
            give_back()

    return rows.mapInArrow(of_batches, schema)
