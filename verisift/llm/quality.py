"""Quality classifier by importance resampling.

Two generative models of hashed word 1- and 2-grams, beginnings of words, beginnings
that recur, and word shapes: one of target text (rows labelled good), one of raw text
(all rows).  A
document's importance is the log ratio of what both say about its distinct
features, perturbed by Gumbel noise that its id fixes; the k documents of the
largest keys are the sample, k being given or the number whose log ratio says target.

* Features count once a document, so one repetitive text can't make a model.
* Each feature stands in two hash tables and has the smaller of its two counts,
  so sharing a bucket with a frequent feature in one of them does no harm.
* A ratio counts only if a likelihood-ratio test says it isn't chance and if it
  is beyond ``MARGIN``; what is merely rare or a little uneven is neutral.
  The test also looks at the rows labelled bad, which are few but pure.
* The raw model is scaled to the target's by the ratio that most frequent
  features have, so that clean features are neutral whatever the share of junk.

Counts cover all documents: each task sends its table once, at most
``SIZE`` rows, and the summed tables, of that fixed size, go to
the driver.  Labels are a sample of at most ``labelled`` rows (by a hash of the
id), the only bound.  Nothing else is shuffled but keys for finding the k-th.

Defined results: null and empty texts, and those without words, are rejected;
labels with a null are ignored; without any labels all texts are kept; a null id
gets the noise of id 0; repeated rows share their fate; other columns are kept
where rows are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.arrow_text import PUNCT, WHITE, chunks, mix, spans_hash, trimmed
from verisift.scratch import materialize

BUCKETS, SHAPES = 1 << 16, 1 << 14
KINDS = 4
SIZE = 2 * KINDS * BUCKETS + SHAPES
#: Bytes of a word's beginning, which words of one stem share.
STEM = 5
#: Shares of a text's words from which a beginning recurs, and recurs often.
RECURS = (0.01, 0.04)
#: A ratio counts from here (natural logarithm), and if twice its log likelihood ratio is this; a document is bad below LIMIT.
MARGIN, TEST, LIMIT = 2.5, 28.0, -3.3
#: Of the log ratio against the noise.
SHARPNESS = 8.0
FLOOR = -60.0


def _shapes(chunk) -> np.ndarray:
    """A number for how each white-space word looks: its last two bytes if they aren't letters, its case, if it repeats the word before."""
    data, start, end = chunk.data.astype(np.int64), chunk.start, chunk.end
    kind = np.zeros(256, np.int64)
    kind[[*b"0123456789"]] = 1
    for b in range(33, 127):
        if not chr(b).isalnum():
            kind[b] = b - 30
    last = kind[data[end - 1]]
    second = np.where(end - start > 1, (kind[data[np.maximum(end - 2, start)]] > 1).astype(np.int64), 0)
    upper = ((data >= 65) & (data <= 90)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(upper)])
    shout = (total[end] - total[start] > 1).astype(np.int64)
    same = np.zeros(len(start), np.int64)
    same[1:] = chunk.word[1:] == chunk.word[:-1]
    return ((last * 2 + second) * 2 + shout) * 2 + same


def _recurring(stem: np.ndarray, row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the beginnings that several words of a text share, with how large a share: a number, and the row."""
    key = np.sort(row << 32 | (stem >> np.uint64(32)).astype(np.int64))  # half a hash tells the beginnings of one text apart
    at = np.flatnonzero(np.diff(key, prepend=-1))
    many, row = np.diff(np.append(at, len(key))), key[at] >> 32
    share = np.searchsorted(RECURS, many / words[row], side="right")
    some = (many > 1) & (share > 0)
    return mix((key[at[some]] & 0xFFFFFFFF).astype(np.uint64) * np.uint64(len(RECURS) + 1) + share[some].astype(np.uint64)), row[some]


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the column: (first row, rows, row of each feature, its place in the first table, in the second)."""
    cuts = (chunks(column, PUNCT, lower=True), chunks(column, WHITE))
    if len(column):
        for chunk in cuts[0]:
            n = chunk.hi - chunk.lo
            row = np.repeat(np.arange(n), np.diff(chunk.first))
            word = chunk.word
            pair, inside = chunk.windows(chunk.sums(), 2)
            long = np.flatnonzero(chunk.end - chunk.start > STEM)
            stem = mix(spans_hash(chunk.byte_sums, chunk.start[long], chunk.start[long] + STEM))
            again, within = _recurring(stem, row[long], np.diff(chunk.first))
            kinds = ((word, row), (pair[inside], row[: len(inside)][inside]), (stem, row[long]), (again, within))
            first = [(h & np.uint64(BUCKETS - 1)).astype(np.int64) + 2 * i * BUCKETS for i, (h, _) in enumerate(kinds)]
            second = [(h >> np.uint64(48)).astype(np.int64) + (2 * i + 1) * BUCKETS for i, (h, _) in enumerate(kinds)]
            yield chunk.lo, n, np.concatenate([r for _, r in kinds]), np.concatenate(first), np.concatenate(second)
        for chunk in cuts[1]:
            n, words = chunk.hi - chunk.lo, np.diff(chunk.first)
            each, many = np.unique(np.repeat(np.arange(n), words) * SHAPES + _shapes(chunk), return_counts=True)
            row = each // SHAPES
            share = np.searchsorted([0.02, 0.1, 0.3], many / words[row])  # how much of the text looks like this
            shape = (each % SHAPES * 4 + share) % SHAPES + 2 * KINDS * BUCKETS
            yield chunk.lo, n, row, shape, shape


def _count_rows(good: np.ndarray, bad: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, SIZE), np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            sides = [(0, np.isin(ids, good)), (1, np.isin(ids, bad)), (2, np.ones(len(ids), bool))]
            for lo, _, row, first, second in _features(batch.column(1)):
                each = np.concatenate([row * SIZE + first, row * SIZE + second]) if first is not second else row * SIZE + first
                each.sort()
                each = each[np.diff(each, prepend=-1) > 0]
                row, place = each // SIZE, each % SIZE
                for side, who in sides:
                    mine = place if side == 2 else place[who[row + lo]]
                    if len(mine):
                        counts[side] += np.bincount(mine, minlength=SIZE)
        some = np.flatnonzero(counts[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), *(pa.array(np.append(c[some], n)) for c, n in zip(counts, (0, 0, rows), strict=True))], ["place", "good", "bad", "raw"]
        )

    return run


def _surprise(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Twice the log likelihood ratio of a hits out of a + b against the share."""
    n = np.maximum(a + b, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - share))), 0))


class Model:
    """Counts of hashed features in good, bad and all texts, and the log ratios they give."""

    def __init__(self, counts: np.ndarray, n_good: int, n_bad: int, n_raw: int):
        self.counts = counts.astype(np.float32)
        often = counts[0] >= 20
        self.scale = float(np.median(counts[0][often] / counts[2][often])) if often.any() else n_good / max(1, n_raw)
        self.scale = min(max(self.scale, 1e-9), 1 - 1e-9)
        self.n_good, self.n_bad, self.n_raw = n_good, n_bad, n_raw

    def ratios(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The log ratio target / raw of each feature; 0 where it could be chance or is small."""
        out = np.zeros(len(first))
        if not self.n_good or not self.n_raw:
            return out
        good, bad, raw = (np.minimum(c[first], c[second]) for c in self.counts)
        times = self.n_good / self.n_bad if self.n_bad else 0.0
        low = np.float32(np.exp(-MARGIN))
        some = np.flatnonzero(good + 0.5 < low * (np.maximum(np.float32(self.scale) * raw, np.float32(times) * bad) + 0.5))
        good, bad, raw = (c[some].astype(np.float64) for c in (good, bad, raw))
        ratio = np.log((good + 0.5) / (self.scale * raw + 0.5))
        sure = _surprise(good, np.maximum(raw - good, 0), self.scale) >= TEST
        found = np.where(sure & (ratio < -MARGIN), ratio, 0)
        if times:
            ratio = np.log((good + 0.5) / (times * bad + 0.5))
            sure = _surprise(bad, good, self.n_bad / (self.n_bad + self.n_good)) >= TEST
            found = np.minimum(found, np.where(sure & (ratio < -MARGIN), ratio, 0))
        out[some] = found
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Log ratio of each text; minus infinity for one without words."""
        out, words = np.zeros(len(column)), np.zeros(len(column), bool)
        for lo, n, row, first, second in _features(column):
            words[lo : lo + n] |= np.bincount(row, minlength=n) > 0
            weight = self.ratios(first, second)
            some = np.flatnonzero(weight)
            each, at = np.unique(row[some] * SIZE + first[some], return_index=True)
            out[lo : lo + n] += np.bincount(each // SIZE, weights=weight[some][at], minlength=n)
        return np.where(words, np.maximum(out, FLOOR), -np.inf)

    def keys(self, ids: pa.Array, column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.scores(column)
        return scores, SHARPNESS * scores + gumbel(ids.fill_null(0).to_numpy(zero_copy_only=False), seed)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    bits = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    return -np.log(-np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``labels``: id_col, quality, toxic (0 or 1)."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).dropna()
    sample = marked.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(labelled).toPandas()
    good, bad = (np.sort(sample.id[sample.good.astype(bool) == side].to_numpy()) for side in (True, False))
    counts = _plain(docs, id_col, text_col).mapInArrow(trimmed(_count_rows(good, bad)), "place long, good long, bad long, raw long")
    table = counts.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("good", "bad", "raw"))).toPandas().set_index("place")
    raw_rows = int(table.raw.get(-1, 0))
    table = table.reindex(range(SIZE), fill_value=0)
    return Model(np.stack([table[c].to_numpy() for c in ("good", "bad", "raw")]), len(good), len(bad), raw_rows)


def _key_rows(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, keys = shared.value.keys(batch.column(0), batch.column(1), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(keys)], ["id", "log_ratio", "key"])

    return run


def kth_largest(keys: DataFrame, k: int, rounds: int = 4, bins: int = 4096) -> float:
    """A bound that ``k`` keys reach, found by counting in ever finer bins: no sort and no collection of keys."""
    low, high = keys.filter("key > double('-Infinity')").agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if width <= 0:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).cast("int")
        counts = dict(keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place.alias("place")).count().collect())
        for place in range(bins - 1, -1, -1):
            if above + counts.get(place, 0) >= k:
                break
            above += counts.get(place, 0)
        low, high = low + place * width, low + (place + 1) * width
    return low


def resample(docs: DataFrame, labels: DataFrame, labelled: int = 50_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> tuple[DataFrame, object, float]:
    """``(keys, model, bound)``: (id, log_ratio, key) of every row; rows whose key reaches the bound are the sample."""
    model = fit(docs, labels, labelled, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keys = materialize(_plain(docs, id_col, text_col).mapInArrow(trimmed(_key_rows(shared, seed)), "id long, log_ratio double, key double"), "keys")
    return keys, shared, kth_largest(keys, keys.filter(F.col("log_ratio") > LIMIT).count() if k is None else k)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = 50_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """``(id_col, log_ratio, key)`` of the documents that are kept: the ``k`` of the largest keys, or all that look like the target."""
    keys, _, bound = resample(docs, labels, labelled, seed, id_col, text_col, k)
    return keys.filter(F.col("key") >= bound).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, labelled: int = 50_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; keys are made again beside the texts, so nothing is joined."""
    _, shared, bound = resample(docs, labels, labelled, seed, id_col, text_col, k)
    at, text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, keys = shared.value.keys(batch.column(at), batch.column(text), seed)
            yield batch.filter(pa.array(keys >= bound))

    return docs.mapInArrow(trimmed(run), docs.schema)
