"""Substring dedup by level-wise doubling.

Level 1 hashes windows of half the wanted length (7 words for 13).  Only a
sample of them is shuffled: in every full window the half window with the
smallest hash, so each full window has exactly one and two equal full windows
have the same.  Half windows that stand in one text alone go no further;
the others are extended to the wanted length (level 2), and of those again only
the repeated ones survive.  :func:`longest_repeats` doubles on, to 26, 52, ...
words, until no candidates survive.

Documents of one word sequence are one candidate: they are told apart by a
digest of the sequence, only the one with the smallest id is searched, and a
later copy has each of its windows in an earlier document by definition.  So a
group of thousands of copies costs a row each.

Shuffled: a (hash, digest) pair for about a quarter of the words, twice; once
more the full windows of the survivors; and the texts, compressed.  Hot windows
are combined before the shuffle, and the joins are plain equi-joins whose skewed
partitions adaptive execution splits.  Two windows or texts are equal if two
64-bit hashes are: of 10^12 windows none are expected to agree by chance.

Defined results: null text is an empty text; a row with a null id is kept whole
and never matched; rows of one id never remove each other's words; empty tables
give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.arrow_text import WHITE, Chunk, chunks, mix, running_sums, signed, spans_hash
from verisift.scratch import materialize

#: Part of the compressor's contract with the last stage, not a limit.
LEVEL = 3
#: Makes the second hash of a word out of the first.
OTHER = 0xD1B54A32D192ED03


def _digests(chunk: Chunk, sums: np.ndarray) -> np.ndarray:
    """A digest of each row's word sequence."""
    first = chunk.first
    return mix(spans_hash(sums, first[:-1], first[1:]) + np.diff(first).astype(np.uint64))


def _twin(chunk: Chunk) -> np.ndarray:
    """Running sums of other hashes of the words; a window or text is told by both."""
    return running_sums(mix(chunk.word ^ np.uint64(OTHER)))


def _seeds(chunk: Chunk, sums: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of full windows, and for each the place and hash of its smallest half window."""
    half = (window + 1) // 2
    hashes, _ = chunk.windows(sums, half)
    n, reach = len(chunk.word) - window + 1, window - half + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for step in range(1, reach):
        lower = hashes[step : step + n] < best
        best[lower] = hashes[step : step + n][lower]
        at[lower] = step
    inside = np.repeat(chunk.first[1:], np.diff(chunk.first))[:n] >= np.arange(window, n + window)
    start = np.flatnonzero(inside)
    return start, start + at[start], best[start]


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0), WHITE):
                sums = chunk.sums()
                _, place, best = _seeds(chunk, sums, window)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                row = np.searchsorted(chunk.first, place[new], "right") - 1
                yield pa.RecordBatch.from_arrays([signed(best[new]), signed(_digests(chunk, sums)[row])], ["seed", "digest"])

    return run


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1), WHITE):
            ids = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo)
            yield pa.RecordBatch.from_arrays([ids, *(signed(_digests(chunk, sums)) for sums in (chunk.sums(), _twin(chunk)))], ["id", "digest", "twin"])


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        for chunk in chunks(batch.column(1), WHITE):
            ids = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo)
            packed = [pack(x.encode() if x else b"") for x in batch.column(1).slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, signed(_digests(chunk, chunk.sums())), pa.array(packed, pa.binary())], ["id", "digest", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _window_rows(window: int):
    """Full windows around the surviving seeds of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1).to_numpy()
            raw = pa.array([x.decode() for x in _unpacked(batch.column(2))], pa.large_string())
            seeds = batch.column(3)
            for chunk in chunks(raw, WHITE):
                sums = chunk.sums()
                start, _, best = _seeds(chunk, sums, window)
                row = np.searchsorted(chunk.first, start, "right") - 1
                keep = np.zeros(len(start), bool)
                bounds = np.searchsorted(row, np.arange(chunk.hi - chunk.lo + 1))
                for i in range(chunk.hi - chunk.lo):
                    a, b = bounds[i], bounds[i + 1]
                    keep[a:b] = np.isin(best[a:b].view(np.int64), np.asarray(seeds[chunk.lo + i].values))
                start, row = start[keep], row[keep]
                full, twin = (mix(spans_hash(s, start, start + window)) for s in (sums, _twin(chunk)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + chunk.lo)), pa.array(digests[row + chunk.lo]), pa.array((start - chunk.first[row]).astype(np.int32)), signed(full), signed(twin)],
                    ["id", "digest", "pos", "full", "twin"],
                )

    return run


def _kept_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for raw, later, places in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = raw.split()
                covered = np.zeros(len(words) + 1, np.int64)
                if later:
                    if len(words) >= window:
                        covered[0] = 1
                elif places:
                    np.add.at(covered, np.asarray(places), 1)
                    np.subtract.at(covered, np.minimum(np.asarray(places) + window, len(words)), 1)
                left = np.cumsum(covered)[:-1] == 0
                total.append(len(words))
                gone.append(len(words) - int(left.sum()))
                kept.append((b" ".join(words) if left.all() else b" ".join([words[i] for i in np.flatnonzero(left)])).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def repeated_windows(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(texts, copies, windows)``, the last levels' tables.

    texts: (id, digest, packed).  copies: (id, digest, first_id), a row for each
    id and word sequence.  windows: (id, digest, pos, full, first_id), each
    window of the first copies that stands in more than one document, with the
    smallest id it stands in.
    """
    docs = _columns(docs, id_col, text_col)
    rows = materialize(docs.mapInArrow(_digest_rows, "id long, digest long, twin long").filter("id is not null").distinct(), "copies")
    firsts = rows.groupBy("digest", "twin").agg(F.min("id").alias("first_id"))
    seeds = docs.filter("id is not null").select("text").mapInArrow(_seed_rows(window), "seed long, digest long")
    shared = materialize(
        seeds.groupBy("seed").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("seed"), "seeds"
    )
    per_text = (
        seeds.join(shared, "seed").groupBy("digest").agg(F.collect_set("seed").alias("seeds")).join(firsts, "digest")
        .select(F.col("first_id").alias("id"), "digest", "seeds")
    )
    texts = docs.mapInArrow(_packed_rows, "id long, digest long, packed binary")
    full = materialize(
        texts.dropna(subset=["id"]).join(materialize(per_text, "candidates"), ["id", "digest"])
        .select("id", "digest", "packed", "seeds").mapInArrow(_window_rows(window), "id long, digest long, pos int, full long, twin long"),
        "windows",
    )
    first = full.groupBy("full", "twin").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id < last_id")
    # written, so that the join deals both sides itself and a hot window's rows can be split
    return texts, rows.join(firsts, ["digest", "twin"]), full.join(materialize(first.drop("last_id"), "firsts"), ["full", "twin"])


def remove_repeated(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_removed, kept_text)`` for every row of ``docs``.

    A word goes if a window of ``window`` words over it also starts in a
    document of a smaller id.
    """
    texts, copies, windows = repeated_windows(docs, window, id_col, text_col)
    places = windows.filter("first_id < id").groupBy("id", "digest").agg(F.collect_set("pos").alias("places"))
    later = copies.filter("first_id < id").select("id", "digest", F.lit(True).alias("later"), F.lit(None).cast("array<int>").alias("places"))
    told = places.select("id", "digest", F.lit(False).alias("later"), "places").union(later)
    told = materialize(told, "removals")
    kept = texts.join(told, ["id", "digest"], "left").select("id", "packed", "later", "places")
    return kept.mapInArrow(_kept_rows(window), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def longest_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, pos, length)``: where repeats start, at the last level that they reach.

    Among the first copies of each text: a window that survives at one length,
    followed at once by another that does, is a candidate at twice the length.
    """
    _, _, windows = repeated_windows(docs, window, id_col, text_col)
    level = materialize(windows.select("id", "digest", "pos", F.xxhash64("full", "twin").alias("full")).distinct(), "level")
    length, found = window, None
    while not level.isEmpty():
        here = level.select(F.col("id").alias(id_col), "digest", "pos", F.lit(length).alias("length"))
        found = here if found is None else found.union(here)
        after = level.select("id", "digest", (F.col("pos") - length).alias("pos"), F.col("full").alias("rest"))
        longer = level.join(after, ["id", "digest", "pos"]).select("id", "digest", "pos", F.xxhash64("full", "rest").alias("full"))
        again = longer.groupBy("full").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("full")
        level, length = materialize(longer.join(again, "full").select("id", "digest", "pos", "full"), "level"), 2 * length
    if found is None:
        return level.select(F.col("id").alias(id_col), "pos", F.lit(window).alias("length"))
    return found.groupBy(id_col, "digest", "pos").agg(F.max("length").alias("length")).drop("digest")
