"""Benchmark decontamination by SimHash of windows.

Windows are as long as an n-gram, or as a shorter item.  An item stands with so
many of them, those that fewest items hold first, that together they weigh more
than the share of it that a copy at the threshold can lack: any such copy holds
one of them free of edits, whose SimHash is equal, so no pair at or above the
threshold is lost (recall 1 but for the verification's 64-bit hashes).  Over each
document a 64-bit SimHash of the words (weighted by length) slides; it comes from
running sums.
Fingerprints are looked up by four blocks of 16 bits: two that differ in at
most three bits agree in a block, so every pair within that radius is found.
A hit is an anchor: of all spans around it that can reach the threshold, of any
length, the one with the best weighted Jaccard similarity of word 5-grams
(weight: their letters) to the item decides, so words may be put in or missing.

Documents are read once for each slice of ``SLICE`` items and nothing is
shuffled but the verified hits.  The benchmark is the query set: it reaches the
driver slice by slice, whatever its size, each slice of a fixed number of items.

Defined results: null and empty texts and items are in no hit; an item shorter
than n words is one n-gram; repeated items or rows hit each by itself; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.arrow_text import PUNCT, chunks, mix, trimmed

RADIUS, BLOCKS, SLICE = 3, 4, 20_000
#: Places of a document whose running sums are held at a time, so a long one takes no more memory.
STRIP = 1 << 13
#: Spans that are compared at a time.
MATRIX = 1 << 18


@dataclass
class Size:
    """Fingerprints of the item windows of one size, and an index by block."""

    words: int
    prints: np.ndarray
    item: np.ndarray
    order: list[np.ndarray]
    begin: list[np.ndarray]


@dataclass
class Grams:
    """The distinct n-grams of an item by hash: where each stands first, how often, and its weight; ``total`` weighs all."""

    words: int
    hashes: np.ndarray
    first: np.ndarray
    times: np.ndarray
    weight: np.ndarray
    total: int


@dataclass
class Index:
    ids: np.ndarray
    grams: list[Grams]
    sizes: list[Size]


def weights(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, 15)


def running(word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Running sums of the 64 signed bits of each word."""
    bits = np.unpackbits(np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    out = np.zeros((len(word) + 1, 64), np.int32)
    np.cumsum((2 * bits - 1) * weights(length)[:, None].astype(np.int8), axis=0, dtype=np.int32, out=out[1:])
    return out


def prints(sums: np.ndarray, size: int) -> np.ndarray:
    if len(sums) <= size:
        return np.zeros(0, np.uint64)
    return np.packbits(sums[size:] > sums[:-size], axis=1).view(np.uint64).ravel()


def _grams(word: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the n-grams of a run of words; one n-gram if they are fewer."""
    n = min(n, len(word))
    total = np.concatenate([[0], np.cumsum(length)])
    hashes = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        hashes = mix(hashes + word[i : len(word) - n + 1 + i])
    return hashes, total[n:] - total[:-n]


def _weighed(word: np.ndarray, length: np.ndarray, n: int) -> Grams:
    if not len(word):
        return Grams(0, np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), 0)
    hashes, weight = _grams(word, length, n)
    own, first, times = np.unique(hashes, return_index=True, return_counts=True)
    return Grams(len(word), own, first, times, weight[first], int((times * weight[first]).sum()))


def _anchors(item: Grams, held: np.ndarray, num: int, den: int) -> np.ndarray:
    """Distinct n-grams of an item, by number, that outweigh all that a copy at num / den can lack; those that fewest items hold first."""
    weight = item.times * item.weight
    order = np.lexsort((-weight, held))
    return order[: int(np.searchsorted(den * np.cumsum(weight[order]), (den - num) * item.total, "right")) + 1]


def build_index(ids: list[int], items: list[str | None], n: int, num: int = 4, den: int = 5) -> Index:
    words = []
    for chunk in chunks(pa.array(items, pa.large_string()), PUNCT, lower=True):
        for i in range(chunk.hi - chunk.lo):
            a, b = chunk.first[i], chunk.first[i + 1]
            words.append((chunk.word[a:b], (chunk.end - chunk.start)[a:b]))
    grams = [_weighed(w, letters, n) for w, letters in words]
    every, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g.hashes for g in grams)]), return_counts=True)
    spans: dict[int, tuple[list, list]] = {}
    for i, ((word, letters), own) in enumerate(zip(words, grams, strict=True)):
        if not len(word):
            continue
        size = min(n, len(word))
        fps = prints(running(word, letters), size)
        for g in _anchors(own, many[np.searchsorted(every, own.hashes)], num, den):
            for store, x in zip(spans.setdefault(size, ([], [])), (fps[own.first[g]], i), strict=True):
                store.append(x)
    sizes = []
    for s, (fp, item) in sorted(spans.items()):
        fp = np.array(fp, np.uint64)
        order = [np.argsort(_block(fp, b), kind="stable") for b in range(BLOCKS)]
        begin = [np.searchsorted(_block(fp, b)[o], np.arange((1 << 16) + 1)) for b, o in enumerate(order)]
        sizes.append(Size(s, fp, np.array(item), order, begin))
    return Index(np.array(ids), grams, sizes)


def _block(fp: np.ndarray, block: int) -> np.ndarray:
    return ((fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)


def near_prints(fp: np.ndarray, size: Size) -> tuple[np.ndarray, np.ndarray]:
    """All (place, item window) within the radius, each at least once."""
    places, found = [], []
    for b in range(BLOCKS):
        value = _block(fp, b)
        low, high = size.begin[b][value], size.begin[b][value + 1]
        some = np.flatnonzero(high > low)
        many = (high - low)[some]
        if not len(some):
            continue
        place = np.repeat(some, many)
        step = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        window = size.order[b][np.repeat(low[some], many) + step]
        near = np.bitwise_count(fp[place] ^ size.prints[window]) <= RADIUS
        places.append(place[near])
        found.append(window[near])
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, int), np.zeros(0, int))


def _near_places(word: np.ndarray, letters: np.ndarray, index: Index) -> Iterator[tuple[Size, int, int]]:
    """(size, place, item window) within the radius, strip by strip; strips overlap by a window, so none is lost."""
    longest = max(size.words for size in index.sizes)
    for a in range(0, len(word), STRIP):
        b = a + STRIP + longest - 1
        sums = running(word[a:b], letters[a:b])
        for size in index.sizes:
            for place, window in zip(*(x.tolist() for x in near_prints(prints(sums[: STRIP + size.words], size.words), size)), strict=True):
                yield size, a + place, window


def _earlier(gram: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each place the place of the same n-gram as many times before as the item has it; -1 if there is none."""
    order = np.argsort(gram, kind="stable")
    same, at = gram[order], np.arange(len(gram))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], same[1:] != same[:-1]]), at, 0))
    many = times[same]
    out = np.empty(len(gram), np.int64)
    out[order] = np.where(at - begin >= many, order[np.maximum(at - many, 0)], -1)
    return out


def best_span(hashes: np.ndarray, weight: np.ndarray, item: Grams, num: int, den: int) -> tuple[int, int, int, int] | None:
    """(shared weight, all weight, first n-gram, last n-gram) of the span of a text's n-grams that is most like the item, if any reaches num / den.

    A best span begins and ends with n-grams of the item, and it weighs at most
    den / num of the item; all such spans are compared.  An n-gram is shared no
    more often than the item has it.
    """
    where = np.minimum(np.searchsorted(item.hashes, hashes), len(item.hashes) - 1)
    at = np.flatnonzero(item.hashes[where] == hashes)
    gram, own = where[at], weight[at]
    most = np.minimum(np.bincount(gram, minlength=len(item.hashes)), item.times)
    if den * int((most * item.weight).sum()) < num * item.total:
        return None
    total = np.concatenate([[0], np.cumsum(weight)])
    back = _earlier(gram, item.times)
    stop = np.searchsorted(total[at + 1], total[at] + den * item.total // num, "right")
    step = max(1, MATRIX // int((stop - np.arange(len(at))).max()))
    best = None
    for a in range(0, len(at), step):
        start = np.arange(a, min(a + step, len(at)))[:, None]
        end = np.arange(a, int(stop[start].max()))[None, :]
        shared = np.cumsum(own[end] * ((end >= start) & (back[end] < start)), axis=1)
        union = np.where(end >= start, total[at[end] + 1] - total[at[start]] + item.total - shared, 1 << 62)
        x, y = np.unravel_index(int((shared / union).argmax()), union.shape)
        s, u = int(shared[x, y]), int(union[x, y])
        if den * s >= num * u and (best is None or s * best[1] > best[0] * u):
            best = s, u, int(at[a + x]), int(at[a + y])
    return best


def _hits(chunk, index: Index, n: int, num: int, den: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(row, item) -> (shared weight, all weight, first word, words) of the best verified span."""
    letters = chunk.end - chunk.start
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    hashes = weight = total = None
    for size, place, window in _near_places(chunk.word, letters, index):
        row = int(np.searchsorted(chunk.first, place, "right")) - 1
        first, last = int(chunk.first[row]), int(chunk.first[row + 1])
        item = int(size.item[window])
        grams = index.grams[item]
        if place + size.words > last:
            continue
        if grams.words < n:  # one n-gram, all of it
            if (row, item) not in best and _grams(chunk.word[place : place + grams.words], letters[place : place + grams.words], n)[0][0] == grams.hashes[0]:
                best[row, item] = grams.total, grams.total, place - first, grams.words
            continue
        if hashes is None:
            hashes, weight = _grams(chunk.word, letters, n)
            total = np.concatenate([[0], np.cumsum(weight)])
        reach = den * grams.total // num
        low = max(first, int(np.searchsorted(total, total[place + 1] - reach, "left")))
        high = min(last - n + 1, int(np.searchsorted(total, total[place + size.words - n] + reach, "right")) - 1)
        runs.setdefault((row, item), []).append((low, high))
    for (row, item), spans in runs.items():
        for low, high in _united(spans):
            found = best_span(hashes[low:high], weight[low:high], index.grams[item], num, den)
            old = best.get((row, item))
            if found and (old is None or found[0] * old[1] > old[0] * found[1]):
                best[row, item] = found[0], found[1], low + found[2] - int(chunk.first[row]), found[3] - found[2] + n
    return best


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low < out[-1][1]:
            low, high = out[-1][0], max(high, out.pop()[1])
        if high > low:
            out.append((low, high))
    return out


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The items in slices of a fixed number, in the order of their ids."""
    plain = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    ids, items = [], []
    for r in plain.toLocalIterator():
        ids.append(r["id"])
        items.append(r["text"])
        if len(ids) == SLICE:
            yield ids, items
            ids, items = [], []
    if ids:
        yield ids, items


def _indexes(benchmark: DataFrame, n: int, threshold: tuple[int, int], id_col: str, text_col: str) -> Iterator:
    context = benchmark.sparkSession.sparkContext
    for ids, items in _slices(benchmark, id_col, text_col):
        index = build_index(ids, items, n, *threshold)
        if index.sizes:
            yield context.broadcast(index)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``(id_col, item_col, similarity, first_word, n_words)``: each item that a row holds, at its best place; ``n_words`` of the row are its copy."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, similarity double, first_word long, n_words long"

    def finder(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = index.value
            for batch in batches:
                for chunk in chunks(batch.column(1), PUNCT, lower=True):
                    found = _hits(chunk, have, n, *threshold)
                    if found:
                        rows, items = zip(*found, strict=True)
                        shared, union, at, many = (np.array(x) for x in zip(*found.values(), strict=True))
                        items = np.array(items)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(np.array(rows) + chunk.lo)), pa.array(have.ids[items]), pa.array(shared / union), pa.array(at), pa.array(many)],
                            ["id", "item", "similarity", "first_word", "n_words"],
                        )

        return run

    out = None
    for index in _indexes(benchmark, n, threshold, item_col, "text"):
        part = plain.mapInArrow(trimmed(finder(index)), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; nothing is shuffled."""
    place = docs.columns.index(text_col)

    def keeper(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for chunk in chunks(batch.column(place), PUNCT, lower=True):
                    for row, _ in _hits(chunk, index.value, n, *threshold):
                        clean[chunk.lo + row] = False
                yield batch.filter(pa.array(clean))

        return run

    for index in _indexes(benchmark, n, threshold, item_col, "text"):
        docs = docs.mapInArrow(trimmed(keeper(index)), docs.schema)
    return docs
