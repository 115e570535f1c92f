"""Truth discovery: groups, votes, copiers, confidences, and single or multiple truths.

Claims are rows (entity, attribute, source_id, row_id, value); claims of a null
never vote and are always in the error view, with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.functions.text import DATE_KINDS, canonical_forms, equality_key, is_null, tokens
from verisift.functions.vectors import cosine, mean_vectors
from verisift.operators.components import connected_components
from verisift.scratch import materialize

#: Prior of copying, its decay, weight of shared truths and errors, decay of history, shares of the best that are kept.
ALPHA, BETA, COPY_DECAY, SHARED_TRUE, SHARED_FALSE = 0.1, 5.0, 0.98, 0.2, 1.0
HISTORY_DECAY, KEEP, KEEP_DELTA = 0.9048374180359595, 0.8, 0.5


def prior_confidence(level: Column) -> Column:
    """Of a level 1 (best) to 5."""
    return F.greatest(0.99 - (level - 1) * 0.2, F.lit(0.001))


def updated_confidence(prior: Column, correct: Column, total: Column, total_rows: Column) -> Column:
    weight = F.greatest(0.1 * total_rows, F.lit(10.0))
    return (prior * weight + correct) / (weight + total)


def distinct_values(claims: DataFrame) -> DataFrame:
    return claims.filter(~is_null(F.col("value"))).select("entity", "attribute", "value").distinct()


def join_minutes(keyed: DataFrame) -> DataFrame:
    """Keys (entity, attribute, value, key) of times, those a minute apart joined: a run of neighbouring minutes has the key of its first."""
    w = W.partitionBy("entity", "attribute").orderBy("_at")
    minutes = keyed.withColumn("_at", F.try_to_timestamp("key", F.lit("yyyy-MM-dd HH:mm"))).filter("_at is not null").select("entity", "attribute", "key", "_at").distinct()
    gap = F.unix_timestamp("_at") - F.unix_timestamp(F.lag("_at").over(w))
    runs = minutes.withColumn("_run", F.sum(F.when(gap <= 60, 0).otherwise(1)).over(w))
    first = runs.groupBy("entity", "attribute", "_run").agg(F.min("key").alias("_first"))
    named = runs.join(first, ["entity", "attribute", "_run"]).select("entity", "attribute", "key", "_first")
    return keyed.join(named, ["entity", "attribute", "key"], "left").select("entity", "attribute", "value", F.coalesce("_first", "key").alias("key"))


def time_keys(claims: DataFrame, kind: str) -> DataFrame:
    """(value, key) of all times, each parsed once however many entities have it; written, so that the join knows its size."""
    shown = claims.filter(~is_null(F.col("value"))).select("value").distinct()
    return materialize(shown.withColumn("key", equality_key(F.col("value"), kind)), "times")


def aligned_keys(claims: DataFrame, kind: str = "general", rules: list[list[dict]] | None = None) -> DataFrame:
    """(entity, attribute, value, key): values of one entity that are equal as they are, or after a rule on either side, have one key.

    A value has the forms that the rules give it; values that share a form,
    directly or through others, are one group, whose key is its smallest form.
    Only distinct values are worked on, never claims, and no pairs are made.
    """
    values = distinct_values(claims)
    if not rules and kind in DATE_KINDS:
        return join_minutes(values.join(time_keys(claims, kind), "value").select("entity", "attribute", "value", "key"))
    if not rules:
        return values.withColumn("key", equality_key(F.col("value"), kind))
    formed = values.select("entity", "attribute", "value", F.explode(canonical_forms(F.col("value"), rules, kind)).alias("form")).filter("form is not null")
    scope = F.concat(F.xxhash64("entity", "attribute").cast("string"), F.lit("|"))
    own = values.withColumn("own", F.concat(scope, equality_key(F.col("value"), kind)))
    edges = formed.join(own.select("entity", "attribute", "value", "own"), ["entity", "attribute", "value"]).select("own", F.concat(scope, F.col("form")).alias("other"))
    groups = connected_components(edges, "own", "other")
    named = own.join(groups.withColumnRenamed("node", "own"), "own", "left").withColumn("key", F.expr("substring(coalesce(component, own), instr(own, '|') + 1)"))
    keyed = named.select("entity", "attribute", "value", "key")
    return join_minutes(keyed) if kind in DATE_KINDS else keyed


def with_keys(claims: DataFrame, kind: str = "general", rules: list[list[dict]] | None = None) -> DataFrame:
    """The claims with their ``key``; null where the value is."""
    return claims.join(aligned_keys(claims, kind, rules), ["entity", "attribute", "value"], "left")


def fuse_aligned(
    claims: DataFrame, kind: str = "general", rules: list[list[dict]] | None = None, confidence: DataFrame | None = None, copying: DataFrame | None = None, multiple: bool = False, penalise: bool = True
) -> DataFrame:
    """:func:`fuse` with values aligned by rules, or times by minutes, before they are grouped."""
    keyed = with_keys(claims, kind, rules)
    return fuse(keyed, confidence, copying, kind, multiple, penalise, F.col("key"))


def group_by_source(claims: DataFrame, confidence: DataFrame | None = None, kind: str = "general", key: Column | None = None) -> DataFrame:
    """Stage one: equal values of a source are a group; its score is its rows times the source's confidence."""
    real = claims.filter(~is_null(F.col("value"))).withColumn("key", key if key is not None else equality_key(F.col("value"), kind))
    groups = real.groupBy("entity", "attribute", "source_id", "key").agg(F.min("value").alias("value"), F.count("*").alias("n_rows"))
    if confidence is None:
        return groups.withColumn("score", F.col("n_rows").cast("double"))
    scored = groups.join(confidence.select("source_id", "confidence"), "source_id", "left")
    return scored.withColumn("score", F.col("n_rows") * F.coalesce("confidence", F.lit(1.0))).drop("confidence")


def copy_probability(stats: DataFrame) -> DataFrame:
    """``(attribute, s, t, c)`` for s < t."""
    return stats.select("attribute", "s", "t", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("c"))


def copy_penalty(groups: DataFrame, copying: DataFrame | None = None) -> DataFrame:
    """λ of each group: Σw² / (Σw² + 2 Σ c·w·w + 1e-9), 1 for a single source; unknown pairs have the prior.

    The pairs are of the sources in one group, whose number the number of
    sources bounds, never the number of rows.
    """
    keys = ["entity", "attribute", "key"]
    a = groups.select(*keys, F.col("source_id").alias("s"), F.col("score").alias("ws"))
    b = groups.select(*keys, F.col("source_id").alias("t"), F.col("score").alias("wt"))
    pairs = a.join(b, keys).filter("s < t")
    prior = F.lit(ALPHA / (ALPHA + BETA))
    if copying is None:
        pairs = pairs.withColumn("c", prior)
    else:
        pairs = pairs.join(copying, ["attribute", "s", "t"], "left").withColumn("c", F.coalesce("c", prior))
    cross = pairs.groupBy(*keys).agg(F.sum(F.col("c") * F.col("ws") * F.col("wt")).alias("cross"))
    own = groups.groupBy(*keys).agg(F.sum(F.col("score") * F.col("score")).alias("square"), F.count("*").alias("n_sources"))
    share = F.col("square") / (F.col("square") + 2 * F.coalesce("cross", F.lit(0.0)) + 1e-9)
    return own.join(cross, keys, "left").select(*keys, F.when(F.col("n_sources") == 1, 1.0).otherwise(share).alias("penalty"))


def merge_sources(groups: DataFrame, copying: DataFrame | None = None, average_rows: float = 1.0, penalise: bool = True) -> DataFrame:
    """Stage two: equal keys of all sources are one group, its score the sum less what copiers add."""
    keys = ["entity", "attribute", "key"]
    merged = groups.groupBy(*keys).agg(
        F.min("value").alias("value"), F.sum("score").alias("weight"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_sources"), F.min("source_id").alias("first_source")
    )
    if not penalise:
        return merged.withColumn("score", F.col("weight") * average_rows).drop("weight")
    lam = F.least(F.greatest("penalty", F.lit(0.0)), F.lit(1.0))
    return merged.join(copy_penalty(groups, copying), keys).withColumn("score", lam * F.col("weight") * average_rows).drop("weight", "penalty")


def single_truth(merged: DataFrame) -> DataFrame:
    """Stage three for values of one truth: the best score wins, ties to the smallest source, then key."""
    rank = F.row_number().over(W.partitionBy("entity", "attribute").orderBy(F.desc(F.round("score", 9)), "first_source", "key"))
    return merged.withColumn("is_true", rank == 1)


def _containers(start: int, above: dict[int, set[int]], skip: int) -> set[int]:
    seen, todo = set(), [start]
    while todo:
        for x in above.get(todo.pop(), ()):
            if x != skip and x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def relations(names: list[list[list[str]]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """``(conflicts, contains)`` between groups given as lists of token lists."""
    sets = [[frozenset(t) for t in g] for g in names]
    conflicts, contains = [], []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            for a, x in enumerate(sets[i]):
                for b, y in enumerate(sets[j]):
                    if y <= x:
                        contains.append((i, j))
                    elif x <= y:
                        contains.append((j, i))
                    elif x & y and len(x ^ y) == 2:
                        p, q = (next(iter(s)) for s in (x - y, y - x)) if len(x - y) == 1 and len(y - x) == 1 else ("", "\0")
                        if p.startswith(q) or q.startswith(p):
                            contains.append((i, j))
                        else:
                            conflicts.append((i, a, j, b))
                    else:
                        continue
                    break
    return conflicts, contains


def resolve(names: list[list[list[str]]], scores: list[float], keep: float = KEEP) -> list[bool]:
    """Which groups are true: conflicts ban the weaker side, the rest are clusters by containment, the strong clusters stay."""
    n = len(scores)
    conflicts, contains = relations(names)
    above: dict[int, set[int]] = {}
    for big, small in contains:
        above.setdefault(small, set()).add(big)
    banned: set[int] = set()
    for i, _, j, _ in conflicts:
        left, right = _containers(i, above, j) | {i}, _containers(j, above, i) | {j}
        if sum(scores[k] for k in left) >= sum(scores[k] for k in right):
            banned |= right - left
        else:
            banned |= left - right
    parent = list(range(n))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in contains:
        if a not in banned and b not in banned:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    total: dict[int, float] = {}
    for k in range(n):
        if k not in banned:
            total[find(k)] = total.get(find(k), 0.0) + scores[k]
    best = max(total.values(), default=0.0)
    return [k not in banned and total[find(k)] >= keep * best - 1e-12 for k in range(n)]


def multi_truth(merged: DataFrame, keep: float = KEEP) -> DataFrame:
    """Stage three for names: relations between token sets, conflicts, clusters. A group is a distinct value of one entity and attribute."""
    tokened = merged.withColumn("names", tokens(F.col("value")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first_source", "key"], kind="stable")
        names = [[list(t) for t in g] for g in frame["names"]]
        return frame.drop(columns="names").assign(is_true=resolve(names, frame["score"].tolist(), keep))

    schema = merged.schema.add("is_true", "boolean")
    return tokened.groupBy("entity", "attribute").applyInPandas(run, schema)


def views(claims: DataFrame, decided: DataFrame, kind: str = "general", key: Column | None = None) -> DataFrame:
    """Every claim with ``score`` and ``is_true``; null claims are false with score 0."""
    keyed = claims.withColumn("key", F.when(is_null(F.col("value")), None).otherwise(key if key is not None else equality_key(F.col("value"), kind)))
    told = keyed.join(decided.select("entity", "attribute", "key", "score", "is_true"), ["entity", "attribute", "key"], "left")
    return told.withColumns({"score": F.coalesce("score", F.lit(0.0)), "is_true": F.coalesce("is_true", F.lit(False))}).drop("key")


def fuse(claims: DataFrame, confidence: DataFrame | None = None, copying: DataFrame | None = None, kind: str = "general", multiple: bool = False, penalise: bool = True, key: Column | None = None) -> DataFrame:
    merged = merge_sources(group_by_source(claims, confidence, kind, key), copying, penalise=penalise)
    return views(claims, multi_truth(merged) if multiple else single_truth(merged), kind, key)


def source_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("source_id").agg(F.count("*").alias("n_total"), F.sum((~F.col("is_true")).cast("long")).alias("n_wrong"))


def copy_evidence(groups: DataFrame, decided: DataFrame) -> DataFrame:
    """What one batch adds to (alpha, beta) of each pair of sources: shared groups, and entities where both stand alone."""
    keys = ["entity", "attribute"]
    told = groups.join(decided.select(*keys, "key", "is_true"), [*keys, "key"])
    a = told.select(*keys, "key", "is_true", F.col("source_id").alias("s"), F.col("n_rows").alias("ns"))
    b = told.select(*keys, "key", F.col("source_id").alias("t"), F.col("n_rows").alias("nt"))
    shared = a.join(b, [*keys, "key"]).filter("s < t").withColumn("w", F.least("ns", "nt") * F.when(F.col("is_true"), SHARED_TRUE).otherwise(SHARED_FALSE))
    per = shared.groupBy(*keys, "s", "t").agg(F.sum("w").alias("w"), F.count("*").alias("n_shared"))
    many = told.groupBy(*keys, "source_id").agg(F.count("*").alias("n"))
    both = many.select(*keys, F.col("source_id").alias("s"), F.col("n").alias("na")).join(many.select(*keys, F.col("source_id").alias("t"), F.col("n").alias("nb")), keys).filter("s < t")
    each = both.join(per, [*keys, "s", "t"], "left").fillna(0, ["w", "n_shared"])
    alone = ((F.col("na") > F.col("n_shared")) & (F.col("nb") > F.col("n_shared"))).cast("double")
    return each.groupBy("attribute", "s", "t").agg(F.sum("w").alias("alpha"), F.sum(alone).alias("beta"))


def update_copying(stats: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """State after a batch: old plus evidence, decayed once."""
    fresh = evidence.select("attribute", "s", "t", F.col("alpha").alias("da"), F.col("beta").alias("db"))
    if stats is None:
        old = fresh.select("attribute", "s", "t", F.lit(ALPHA).alias("alpha"), F.lit(BETA).alias("beta"))
    else:
        old = stats
    both = old.join(fresh, ["attribute", "s", "t"], "full")
    grown = lambda c, d, p: (F.coalesce(F.col(c), F.lit(p)) + F.coalesce(F.col(d), F.lit(0.0))) * COPY_DECAY
    return both.select("attribute", "s", "t", grown("alpha", "da", ALPHA).alias("alpha"), grown("beta", "db", BETA).alias("beta"))


def majority_vote(claims: DataFrame, top: int = 10) -> DataFrame:
    real = claims.filter(~is_null(F.col("value"))).groupBy("entity", "attribute", "value").agg(F.count("*").alias("votes"))
    rank = F.row_number().over(W.partitionBy("entity", "attribute").orderBy(F.desc("votes"), "value"))
    return real.withColumn("rank", rank).filter(F.col("rank") <= top)


def extract_answers(scored: DataFrame, multiple: bool, share: float = 0.8, tie_in: bool = True) -> DataFrame:
    """Truths out of scores: above a share of the best, or the best and, with ``tie_in``, all claims of its value (answers of a batch have none)."""
    w = W.partitionBy("entity", "attribute")
    top = F.max("score").over(w)
    if multiple:
        return scored.withColumn("is_true", F.col("score") > share * top)
    if not tie_in:
        return scored.withColumn("is_true", F.col("score") == top)
    best = F.first("value").over(w.orderBy(F.desc("score"), "value"))
    return scored.withColumn("is_true", (F.col("score") == top) | (F.col("value") == best))


def cosine_scores(claims: DataFrame) -> DataFrame:
    """Claims (entity, attribute, ..., embedding) with ``score``: the cosine to the mean vector of all claims of the entity and attribute."""
    keys = ["entity", "attribute"]
    means = mean_vectors(claims, keys, "embedding", "_mean")
    return claims.join(means, keys, "left").withColumn("score", cosine(F.col("embedding"), F.col("_mean"))).drop("_mean")


def confidence_statistics(view: DataFrame, condition: str) -> DataFrame:
    """(source_id, condition, attribute, correct, total) of a fused view, for :func:`updated_confidence`; claims of a null don't count."""
    real = view.filter(~is_null(F.col("value")))
    return real.groupBy("source_id", F.lit(condition).alias("condition"), "attribute").agg(F.sum(F.col("is_true").cast("long")).alias("correct"), F.count("*").alias("total"))


def learned_confidence(statistics: DataFrame, levels: DataFrame, total_rows: int) -> DataFrame:
    """(source_id, condition, attribute, confidence) from cumulative statistics and the sources' levels (none: confidence 1 before)."""
    known = statistics.groupBy("source_id", "condition", "attribute").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    told = known.join(levels.select("source_id", "confidence_level"), "source_id", "left")
    prior = F.when(F.col("confidence_level").isNull(), 1.0).otherwise(prior_confidence(F.col("confidence_level")))
    return told.select("source_id", "condition", "attribute", updated_confidence(prior, F.col("correct"), F.col("total"), F.lit(total_rows)).alias("confidence"))


def failure_classes(failures: DataFrame) -> DataFrame:
    """(attribute, component, values): values that failed to align, directly or through others, as one class each, for whoever proposes rules."""
    mark = lambda c: F.concat("attribute", F.lit("\x1f"), c)
    found = connected_components(failures.select(mark("true_value").alias("a"), mark("error_value").alias("b")), "a", "b")
    part = lambda c, i: F.get(F.split(c, "\x1f"), F.lit(i))
    return found.groupBy(part("component", 0).alias("attribute"), part("component", 1).alias("component")).agg(F.array_sort(F.collect_set(part("node", 1))).alias("values"))


def passthrough(claims: DataFrame) -> DataFrame:
    """No fusion: every claim with score 1."""
    return claims.withColumns({"score": F.lit(1.0), "is_true": ~is_null(F.col("value"))})


def union_all(frames: Iterator[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def alignment_failures(view: DataFrame, last: int = 5) -> DataFrame:
    """Pairs of a true and an error value of one entity, the ``last`` smallest of each pair of sources: what rules might align."""
    t = view.filter("is_true").groupBy("entity", "attribute", F.col("source_id").alias("true_source")).agg(F.min("value").alias("true_value"))
    e = view.filter(~F.col("is_true") & ~is_null(F.col("value"))).select("entity", "attribute", F.col("source_id").alias("error_source"), F.col("value").alias("error_value")).distinct()
    pairs = t.join(e, ["entity", "attribute"]).select("attribute", "true_source", "error_source", "true_value", "error_value").distinct()
    rank = F.row_number().over(W.partitionBy("attribute", "true_source", "error_source").orderBy("true_value", "error_value"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= last)


# ---- history -------------------------------------------------------------------------------------------------------


def decay_groups(history: DataFrame, factor: float = HISTORY_DECAY) -> DataFrame:
    return history.withColumn("score", F.col("score") * factor)


def merge_history(history: DataFrame, delta: DataFrame) -> DataFrame:
    """Decayed history and new groups, met by key; history's score fades once a batch in which the entity is touched."""
    keys = ["entity", "attribute", "key"]
    touched = delta.select("entity", "attribute").distinct().withColumn("_hit", F.lit(True))
    old = history.join(touched, ["entity", "attribute"], "left")
    old = old.withColumn("score", F.when(F.col("_hit"), F.col("score") * HISTORY_DECAY).otherwise(F.col("score"))).drop("_hit")
    cols = [*keys, "value", "score", "n_rows", "n_sources", "first_source"]
    both = old.select(*cols).unionByName(delta.select(*cols))
    return both.groupBy(*keys).agg(
        F.min("value").alias("value"), F.sum("score").alias("score"), F.sum("n_rows").alias("n_rows"), F.max("n_sources").alias("n_sources"), F.min("first_source").alias("first_source")
    )
