"""N-gram Jaccard join by MinHash banding.

Every document is its set of word 5-grams.  Documents of equal sets are one
class, represented by the smallest id; classes get a MinHash signature cut into
bands whose number and height follow from the wanted recall at the threshold.
Only band hashes are shuffled.  A pair of classes belongs to the first band in
which it meets, so it is verified once, on the full sets, and counted once.

Buckets of more than ``BLOCK`` classes are cut into blocks by a hash, and pairs
of blocks go to tasks: a group of any size is spread over tasks of at most two
blocks, no pair is lost, and no pair is ever a row.  A verified bucket gives a
row for each class: its number of links and one linked class, and from these
come the connected groups.

Defined results: null and empty texts, and those of no words, have no n-grams
and no links; a text of fewer than n words is one n-gram; a row with a null id
is returned in no class.  Repeated rows are one class.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.arrow_text import PUNCT, Chunk, chunks, mix, signed, spans_hash, trimmed
from verisift.operators.components import connected_components
from verisift.scratch import materialize

#: Classes in a block; a task that verifies holds two blocks of texts at most.
BLOCK = 192


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows) of the fewest false candidates that find a pair at ``threshold`` with ``recall``.

    Rows are as many as ``most`` hashes allow: taller bands let fewer pairs of
    low similarity meet.
    """
    for rows in range(16, 0, -1):
        missed = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(missed))) if 0 < missed < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding within the hashes allowed")


def shingles(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-grams, and where each row's begin."""
    sums = chunk.sums()
    size = np.diff(chunk.first)
    hashes, inside = chunk.windows(sums, n)
    owner = np.repeat(np.arange(len(size)), size)
    short = np.flatnonzero((size > 0) & (size < n))
    whole = mix(spans_hash(sums, chunk.first[short], chunk.first[short] + size[short]) + size[short].astype(np.uint64))
    every = np.concatenate([hashes[inside], whole])
    row = np.concatenate([owner[: len(inside)][inside], short])
    order = np.argsort(row, kind="stable")
    return every[order], np.searchsorted(row[order], np.arange(len(size) + 1))


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(7)
    times = rng.integers(1 << 20, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(grams: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(grams), 2048):
            x = grams[None, at : at + 2048] * times[:, None]
            x += plus[:, None]
            low = np.minimum(low, x.view(np.uint32)[:, 1::2].min(axis=1))
        parts = low.reshape(bands, rows).astype(np.uint64)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for i in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
        return out

    return sign


def _signature_rows(n: int, bands: int, rows: int):
    sign = _signer(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), PUNCT, lower=True):
                grams, first = shingles(chunk, n)
                many = chunk.hi - chunk.lo
                digest, check, found = np.zeros(many, np.uint64), np.zeros(many, np.uint64), []
                for i in range(many):
                    own = np.unique(grams[first[i] : first[i + 1]])
                    digest[i], check[i] = own.sum() + np.uint64(len(own)), mix(own).sum()
                    found.append(sign(own).view(np.int64) if len(own) else None)
                part = batch.slice(chunk.lo, many)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), signed(digest), signed(check), pa.array(found, pa.list_(pa.int64()))],
                    ["id", "row", "digest", "check", "bands"],
                )

    return run


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [pack((x or "").encode()) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "row", "packed"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading ``keys`` columns, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if batch.num_rows > 1 else np.zeros(0, int)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _new_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bands, which pairs of them meet here for the first time) of one bucket or pair of blocks."""
    ids = table["id"].to_numpy()
    ids, at = np.unique(ids, return_index=True)
    bands = np.stack(table["bands"].to_numpy()[at])
    band, p, q = (int(table[c][0].as_py()) for c in ("band", "p", "q"))
    new = np.ones((len(ids), len(ids)), bool)
    for j in range(band):
        new &= bands[:, None, j] != bands[None, :, j]
    if p != q:
        block = table["block"].to_numpy()[at]
        new &= block[:, None] != block[None, :]
    np.fill_diagonal(new, False)
    return ids, at, new


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the members of a bucket that have a new pair there."""
    for table in _groups(batches, 4):
        _, at, new = _new_pairs(table)
        keep = at[new.any(axis=1)]
        if len(keep):
            yield from table.take(pa.array(np.sort(keep))).combine_chunks().to_batches()


def _verified_rows(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for table in _groups(batches, 4):
            ids, at, new = _new_pairs(table)
            if len(ids) < 2:
                continue
            text = pa.array([unpack(table["packed"][int(i)].as_py()).decode() for i in at], pa.large_string())
            sets = []
            for chunk in chunks(text, PUNCT, lower=True):
                grams, first = shingles(chunk, n)
                sets += [np.unique(grams[first[i] : first[i + 1]]) for i in range(chunk.hi - chunk.lo)]
            size = np.array([len(s) for s in sets])
            common = _common(sets)
            linked = new & (common * den >= num * (size[:, None] + size[None, :] - common))
            links = linked.sum(axis=1)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[_roots(linked)[some]]), pa.array(ids[linked[some].argmax(axis=1)])],
                    ["id", "links", "root", "partner"],
                )

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share: products of 0/1 matrices over slices of the members."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    many = np.bincount(code, minlength=len(every))
    wide = np.cumsum(many > 1) - 1  # members of one set alone add nothing off the diagonal
    keep = many[code] > 1
    owner, code, width = owner[keep], wide[code[keep]], int((many > 1).sum())
    step = max(256, (8 << 20) // max(1, m))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(code, (lo, lo + step))
        part = np.zeros((m, min(step, width - lo)), np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _roots(linked: np.ndarray) -> np.ndarray:
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, class_id, copy_of, n_links, partner_id)`` for every row.

    copy_of: the smallest id with the same n-gram set.  n_links: how many other
    sets are at the threshold or above (a fraction of two integers, compared
    exactly).  class_id: the smallest id of all that are connected by links or
    copies.  partner_id: one linked copy_of, null where there is none.
    """
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("row"), F.col(text_col).cast("string").alias("text"))
    signed_ = materialize(plain.mapInArrow(trimmed(_signature_rows(n, bands, rows)), "id long, row long, digest long, check long, bands array<long>"), "signatures")
    known = signed_.filter("bands is not null and id is not null")
    classes = materialize(
        known.groupBy("digest", "check").agg(F.min(F.struct("id", "row", "bands")).alias("r")).select("digest", "check", "r.id", "r.row", "r.bands"), "classes"
    )
    buckets = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = (
        buckets.join(shared, ["band", "bucket"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(id, 11), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("band", "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "block")
    )
    key = ["band", "bucket", "p", "q"]
    schema = "band int, bucket long, p int, q int, id long, block int, row long, bands array<long>"
    opened = met.join(classes.select("id", "row", "bands"), "id").select(*key, "id", "block", "row", "bands")
    opened = materialize(opened.repartition(*key).sortWithinPartitions(*key).mapInArrow(trimmed(_open_rows), schema), "opened")
    packed = plain.filter("id is not null").mapInArrow(trimmed(_packed_rows), "id long, row long, packed binary")
    full = opened.join(packed, ["id", "row"]).select(*key, "id", "block", "bands", "packed")
    verified = materialize(
        full.repartition(*key).sortWithinPartitions(*key).mapInArrow(trimmed(_verified_rows(n, *threshold)), "id long, links long, root long, partner long"), "links"
    )
    groups = connected_components(verified, "id", "root")
    links = verified.groupBy("id").agg(F.sum("links").alias("n_links"), F.min("partner").alias("partner_id"))
    found = links.join(groups.withColumnRenamed("node", "id"), "id", "left")
    told = classes.select("digest", "check", "id").join(found, "id", "left").withColumnRenamed("id", "copy_of")
    # written, so that the one join of all rows deals both sides itself and the rows of a hot class can be split
    rows_ = signed_.select("id", "digest", "check").join(materialize(told, "found"), ["digest", "check"], "left")
    rows_ = rows_.withColumn("copy_of", F.when(F.col("id").isNotNull(), F.coalesce("copy_of", "id")))
    return rows_.select(
        F.col("id").alias(id_col), F.coalesce("component", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "partner_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).filter(f"class_id <> {id_col}").select(F.col(id_col).alias("_later")).distinct()
    found = materialize(found, "later")
    return docs.join(found, docs[id_col] == found["_later"], "left_anti")
