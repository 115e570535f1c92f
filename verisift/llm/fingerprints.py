"""Document fingerprints: invertible Bloom lookup sketches, on DataFrame functions alone.

A text is the set of its paragraphs (lines).  Every paragraph has a 60-bit
digest, whose three thirds name a cell in each of three tables, and 31 check
bits.  A cell holds the XOR of its digests and of their check bits; a
sketch is the list of its cells that aren't empty, in order.  Tables have a power
of two of cells, at least as many as paragraphs, so a sketch folds to any smaller
size, and two versions of any length can be subtracted.

A comparison folds both fingerprints to the size of the smaller, or one for the
least difference that their counts allow, and subtracts: what both hold vanishes.  Peeling takes out the
digest of each cell that holds just one (its check bits and its place agree), round
by round.  If cells are left, or a digest came out twice, all is done again at twice
the size; beyond a fingerprint's own size, its sketch is made anew from the
paragraphs.  After ``SIZES`` failures, each at twice the size, the digests
themselves are compared, so a difference is never incomplete.

Everything happens within a row; cells are combined by a sort and one pass over
its runs, so the cost is in proportion to the text times the logarithm of its lines.
:func:`successors` pairs each row with the next one by ranges of ids cut at
quantiles, so its texts are shuffled once and no task sees more than a range,
whatever ids there are; rows of one id or without one are dealt by a hash.

Defined results: a null text is empty; an empty text is the set of no paragraph,
like itself (1) and unlike any other (0); repeated paragraphs count once;
repeated rows and ids have the same fingerprint for the same text; of one id, the
row with the smaller hash of its text is first; rows with a null id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.scratch import materialize

#: Cells of a table at least; tables; rounds of a peeling, and sizes that are tried before the digests are compared.
CELLS, TABLES, ROUNDS, SIZES = 8, 3, 16, 8
#: Cells of a table for each paragraph: those that are empty take no place.
SPARE = 4
#: Cells of a table at most, as a place has 20 bits of a digest.
MOST = 1 << 20
#: Rows of a range in :func:`successors`, and ranges at most.
RANGE_ROWS, RANGES = 2000, 20_000
CELL = "struct<place:int,digest:bigint,check:bigint>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex(text: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(text, at, digits), 16, 10).cast("long")


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    return F.transform(F.array_distinct(lines), lambda x: _hex(F.md5(x.cast("binary")), 1, 15))


def room(n: Column) -> Column:
    """The least power of two that is ``CELLS`` and ``n`` or more."""
    return F.least(F.lit(MOST), F.greatest(F.lit(CELLS), F.call_function("shiftleft", F.lit(1), F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0))))


def _place(digest: Column, table: int, size: Column) -> Column:
    """Twenty bits of the digest for each table."""
    return (F.lit(table) * size + F.shiftright(digest, 20 * table).bitwiseAND((size - 1).cast("long"))).cast("int")


def _check(digest: Column) -> Column:
    """A product of the digest's halves modulo a prime: what the XOR of several digests has is not the XOR of theirs."""
    return F.pmod((digest.bitwiseAND(F.lit(2**30 - 1)) + 12345) * (F.shiftright(digest, 30) + 67890), F.lit(2**31 - 1))


def _placed(of: Column, size: Column) -> Column:
    """Each digest with its check bits, once for each of its cells."""

    def cells(digest: Column) -> Column:
        def each(check: Column) -> Column:
            return F.array(*(F.struct(_place(digest, t, size).alias("place"), digest.alias("digest"), check.alias("check")) for t in range(TABLES)))

        return _let(_check(digest), each)

    return F.flatten(F.transform(of, cells))


def combine(cells: Column) -> Column:
    """Cells of one place as one, by XOR; empty ones are left out.  The result is in order of place."""

    def runs(sort: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(sort) - 1), lambda i: (i == 0) | (F.get(sort, i)["place"] != F.get(sort, i - 1)["place"]))

        def merged(starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                last = F.coalesce(F.get(starts, k + 1), F.size(sort)) - 1
                zero = F.struct(F.get(sort, start)["place"].alias("place"), F.lit(0).cast("long").alias("digest"), F.lit(0).cast("long").alias("check"))

                def add(acc: Column, i: Column) -> Column:
                    c = F.get(sort, i)
                    return F.struct(acc["place"].alias("place"), acc["digest"].bitwiseXOR(c["digest"]).alias("digest"), acc["check"].bitwiseXOR(c["check"]).alias("check"))

                return F.when(last == start, F.get(sort, start)).otherwise(F.aggregate(F.sequence(start, last), zero, add))

            return F.filter(F.transform(starts, one), lambda c: (c["digest"] != 0) | (c["check"] != 0))

        return F.when(F.size(sort) == 0, F.expr(f"cast(array() as array<{CELL}>)")).otherwise(_let(first, merged))

    return _let(F.sort_array(cells), runs)


def sketch(of: Column, size: Column) -> Column:
    """The cells of a set of digests, in tables of ``size``."""
    return combine(_placed(of, size))


def fold(cells: Column, own: Column, size: Column) -> Column:
    """A sketch of tables of ``own`` cells as one of fewer."""

    def moved(c: Column) -> Column:
        table = F.floor(c["place"] / own).cast("int")
        return F.struct((table * size + F.pmod(c["place"], size)).cast("int").alias("place"), c["digest"].alias("digest"), c["check"].alias("check"))

    return F.when(size == own, cells).otherwise(combine(F.transform(cells, moved)))


def subtract(a: Column, b: Column) -> Column:
    return combine(F.concat(a, b))


def _alone(cells: Column, size: Column) -> Column:
    """The digests of the cells that hold just one."""

    def holds(c: Column) -> Column:
        place = c["place"]
        here = F.when(place < size, _place(c["digest"], 0, size)).when(place < 2 * size, _place(c["digest"], 1, size)).otherwise(_place(c["digest"], 2, size))
        return (_check(c["digest"]) == c["check"]) & (here == place)

    return F.array_distinct(F.transform(F.filter(cells, holds), lambda c: c["digest"]))


NONE = "cast(array() as array<bigint>)"


def peel(cells: Column, size: Column) -> Column:
    """(cells, found, stuck): the digests found one by one; no cells means all were found."""
    start = F.struct(cells.alias("cells"), F.expr(NONE).alias("found"), (F.size(cells) == 0).alias("stuck"))

    def again(state: Column, _: Column) -> Column:
        def taken(alone: Column) -> Column:
            left = subtract(state["cells"], _placed(alone, size))
            return F.struct(left.alias("cells"), F.concat(state["found"], alone).alias("found"), (F.size(alone) == 0).alias("stuck"))

        return F.when(state["stuck"], state).otherwise(_let(_alone(state["cells"], size), taken))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, again)


def version(of: Column) -> Column:
    """(digests, size, cells): a set of digests and its sketch of its own size."""
    return _let(of, lambda d: _let(room(F.size(d) * SPARE), lambda size: F.struct(d.alias("digests"), size.alias("size"), sketch(d, size).alias("cells"))))


def _at(v: Column, size: Column) -> Column:
    return F.when(size <= v["size"], fold(v["cells"], v["size"], size)).otherwise(sketch(v["digests"], size))


def _first_size(a: Column, b: Column) -> Column:
    """That of the smaller fingerprint, or for the least difference that the counts allow."""
    return F.greatest(F.least(a["size"], b["size"]), room(F.abs(F.size(a["digests"]) - F.size(b["digests"]))))


def difference(a: Column, b: Column) -> Column:
    """(found, tries) of two versions: the digests in which they differ, and how many sizes it took (0: digests were compared)."""
    start = F.struct(F.lit(False).alias("whole"), F.expr(NONE).alias("found"), _first_size(a, b).alias("size"), F.lit(0).alias("tries"))

    def again(acc: Column, _: Column) -> Column:
        def told(done: Column) -> Column:
            whole = (F.size(done["cells"]) == 0) & (F.size(F.array_distinct(done["found"])) == F.size(done["found"]))
            return F.struct(whole.alias("whole"), done["found"].alias("found"), (acc["size"] * 2).alias("size"), (acc["tries"] + 1).alias("tries"))

        tried = _let(peel(subtract(_at(a, acc["size"]), _at(b, acc["size"])), acc["size"]), told)
        return F.when(acc["whole"], acc).otherwise(tried)

    def ended(acc: Column) -> Column:
        exact = F.concat(F.array_except(a["digests"], b["digests"]), F.array_except(b["digests"], a["digests"]))
        return F.struct(F.when(acc["whole"], acc["found"]).otherwise(exact).alias("found"), F.when(acc["whole"], acc["tries"]).otherwise(0).alias("tries"))

    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(SIZES)), start, again), ended)


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared paragraphs over all, 0 to 1, from the recovered difference; 1 for two empty sets."""
    total = F.size(a["digests"]) + F.size(b["digests"])
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - F.size(difference(a, b)["found"]) / total)


def fingerprint(v: Column) -> Column:
    """A version's sketch as text: the number of paragraphs, cells of a table, and place, digest and check bits of each cell in use."""
    shown = F.array_join(F.transform(v["cells"], lambda c: F.concat_ws("-", c["place"].cast("string"), F.lower(F.hex(c["digest"])), F.lower(F.hex(c["check"])))), ".")
    return F.concat_ws(":", F.size(v["digests"]).cast("string"), v["size"].cast("string"), shown)


def _range_of(bounds: list[int]):
    """For an id and a number from 0 to 1: how many bounds are before it; a bound that stands several times is an id of so many ranges, told apart by the number."""
    steps = max(1, len(bounds).bit_length())
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def before(id_: Column, strict: bool) -> Column:
        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            seen = F.get(known, mid)
            down = (seen > id_) if strict else (seen >= id_)  # bounds fall, as ids do
            return F.when(acc["low"] >= acc["high"], acc).when(down, F.struct((mid + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), mid.alias("high")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step)["low"]

    def place(id_: Column, share: Column) -> Column:
        low, high = before(id_, True), before(id_, False)
        return (low + F.floor(share * (high - low + 1)).cast("int")) if bounds else F.lit(0)

    return place


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, next_text)``: the text of the next row by descending id, of the first row after the last.

    Ranges are cut at quantiles of the ids, ``RANGE_ROWS`` rows in each as long
    as they are no more than ``RANGES``; the last row of a range finds its
    successor among the first rows of ranges, one row a range.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("deal", F.shiftrightunsigned(F.xxhash64("text"), 1))
    known, many = plain.agg(F.count("id"), F.count("*")).first()
    ranges = max(1, min(RANGES, known // RANGE_ROWS))
    found = F.percentile_approx("id", [i / ranges for i in range(ranges - 1, 0, -1)], 4 * ranges)
    bounds = plain.agg(found).first()[0] if ranges > 1 else []
    share = F.col("deal") / F.lit(2.0**63)
    lost = max(1, min(RANGES, (many - known) // RANGE_ROWS))
    place = F.when(F.col("id").isNull(), ranges + F.least(F.floor(share * lost), F.lit(lost - 1))).otherwise(_range_of(list(bounds))(F.col("id"), share))
    cut = plain.withColumn("range", place.cast("int"))
    order = [F.col("id").desc_nulls_last(), "deal", "text"]
    inside = cut.withColumn("next_text", F.lead("text").over(W.partitionBy("range").orderBy(*order)))
    head = F.min(F.struct(F.bitwise_not("id").alias("back"), "deal"))
    firsts = materialize(cut.groupBy("range").agg(head.alias("h")).select("range", "h.back", "h.deal"), "ranges")  # 2 RANGES rows at most
    one = W.partitionBy(F.lit(0))
    links = firsts.select("range", F.coalesce(F.lead("range").over(one.orderBy("range")), F.min("range").over(one)).alias("after"))
    here = (cut["range"] == firsts["range"]) & F.bitwise_not(cut["id"]).eqNullSafe(firsts["back"]) & (cut["deal"] == firsts["deal"])
    heads = cut.join(F.broadcast(firsts), here, "left_semi").groupBy("range").agg(F.min("text").alias("head_text")).withColumnRenamed("range", "after")
    follow = F.broadcast(links).join(heads, "after").select("range", "head_text")
    return inside.join(follow, "range", "left").select("id", "text", F.coalesce("next_text", "head_text").alias("next_text"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, edited_text, next_text)``: the last half of each text replaced by the beginning of the next, as long."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    return successors(docs, id_col, text_col).select("id", "text", edited.alias("edited_text"), "next_text")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; see :func:`edited_pairs`."""
    pairs = edited_pairs(docs, id_col, text_col)
    sets = pairs.select("id", "text", "edited_text", *(version(digests(F.col(c))).alias(v) for v, c in (("a", "text"), ("b", "edited_text"), ("c", "next_text"))))
    return sets.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
