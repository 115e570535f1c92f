"""Classical truth-discovery models, many entities at a time.

Each model is a pure function of an entity's claims to a score for each value.
The models here work on arrays over entities of one shape (numbers of sources and
values), so that an entity costs a few array operations' share and not a call of
its own; :func:`run_model` streams the sorted claims of a partition through them.
Randomness is seeded by the entity, so results don't depend on partitions or on
who shares an array.  An entity is a group of at most (sources x values) rows,
after claims have been made distinct.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-10
#: Rows of claims that are gathered before they are scored, and elements of the arrays of one shape.
ROWS, ELEMENTS = 200_000, 2_000_000
#: The array form of a model, by the model.
MANY: dict[Callable, Callable] = {}


def _matrix(frame: pd.DataFrame) -> tuple[list, list, np.ndarray]:
    sources, values = sorted(frame["source_id"].unique()), sorted(frame["value"].unique())
    m = np.zeros((len(sources), len(values)))
    m[frame["source_id"].map(sources.index), frame["value"].map(values.index)] = 1
    return sources, values, m


def many(scores: Callable[..., np.ndarray]) -> Callable[..., dict[str, float]]:
    """A model of one entity's claims from its array form: (claims m[entity, source, value], values, seeds and vectors of each entity, options) -> score[entity, value]."""

    @wraps(scores)
    def model(frame: pd.DataFrame, seed: int = 0, **options) -> dict[str, float]:
        _, values, m = _matrix(frame)
        known = dict(zip(frame["value"], frame["embedding"], strict=True)) if "embedding" in frame else {}
        found = scores(m[None], values=[values], seeds=[seed], vectors=[[known.get(x) for x in values]], **options)
        return dict(zip(values, found[0], strict=True))

    MANY[model] = scores
    return model


@many
def majority(m: np.ndarray, **_) -> np.ndarray:
    return m.sum(axis=1) / m.sum(axis=(1, 2))[:, None]


@many
def dart(m: np.ndarray, beta: float = 0.5, recall: float = 0.8, specificity: float = 0.9, iterations: int = 20, **_) -> np.ndarray:
    size, n, v = m.shape
    given = m.sum(axis=2, keepdims=True)
    conf = np.where(m > 0, (1 - (v - given) / v**2) / given, 1 / v**2)
    said, unsaid, rest = m * conf, (1 - m) * conf, (1 - m).sum(axis=2)
    rec, sp = np.full((size, n), recall), np.full((size, n), specificity)
    for _i in range(iterations):
        clip = lambda x: np.clip(x, EPS, 1)
        plus = (said * np.log(clip(rec))[:, :, None] + unsaid * np.log(1 - sp + EPS)[:, :, None]).sum(axis=1)
        minus = (said * np.log(1 - rec + EPS)[:, :, None] + unsaid * np.log(clip(sp))[:, :, None]).sum(axis=1)
        ver = 1 / (1 + ((1 - beta) / (beta + EPS)) * np.exp(np.clip(minus - plus, -700, 700)))
        rec = (m * ver[:, None, :]).sum(axis=2) / given[:, :, 0]
        sp = np.where(rest > 0, ((1 - m) * (1 - ver)[:, None, :]).sum(axis=2) / np.maximum(rest, 1), sp)
    return ver


def _dice(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * sum((Counter(a) & Counter(b)).values()) / total if total else 0.0


def _turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - (a * b).sum(axis=-1) / np.maximum(np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1), EPS)


def _implication(values: list[str], vectors: list, base: float) -> np.ndarray:
    imp = np.zeros((len(values), len(values)))
    for i, (x, a) in enumerate(zip(values, vectors, strict=True)):
        for j, (y, b) in enumerate(zip(values, vectors, strict=True)):
            if i != j:
                cos = 1 - _turned(np.asarray(a, float), np.asarray(b, float)) if a is not None and b is not None and np.any(a) and np.any(b) else 0.0
                imp[i, j] = np.clip((cos + _dice(x, y)) / 2 - base, -1, 1)
    return imp


@many
def truth_finder(
    m: np.ndarray, values: list, vectors: list, trust: float = 0.9, gamma: float = 0.3, rho: float = 0.5, base: float = 0.6, iterations: int = 10, tolerance: float = 1e-3, implication: bool = True, **_
) -> np.ndarray:
    size, n, v = m.shape
    imp = np.zeros((size, v, v))
    if implication:
        plain: dict[tuple, np.ndarray] = {}  # values without vectors imply each other alike in all entities
        for e, (own, known) in enumerate(zip(values, vectors, strict=True)):
            if any(x is not None for x in known):
                imp[e] = _implication(own, known, base)
            else:
                key = tuple(own)
                if key not in plain:
                    plain[key] = _implication(own, known, base)
                imp[e] = plain[key]
    t, ver, out, left = np.full((size, n), trust), np.zeros((size, v)), np.zeros((size, v)), np.arange(size)
    for _i in range(iterations):
        sigma = (m * -np.log(1 - t)[:, :, None]).sum(axis=1)
        fresh = 1 / (1 + np.exp(-gamma * (sigma + rho * (imp @ sigma[:, :, None])[:, :, 0])))
        new = np.clip((m * fresh[:, None, :]).sum(axis=2) / m.sum(axis=2), 1e-12, 1 - 1e-12)
        done = np.maximum(_turned(t, new), _turned(ver, fresh)) < tolerance
        t, ver = new, fresh
        out[left] = ver
        if done.any():
            left, m, imp, t, ver = left[~done], m[~done], imp[~done], t[~done], ver[~done]
        if not len(left):
            break
    return out


@many
def ltm(m: np.ndarray, seeds: list, alpha0: tuple = (50, 10), alpha1: tuple = (10, 10), beta: tuple = (10, 10), sweeps: int = 50, burn: int = 10, thin: int = 2, **_) -> np.ndarray:
    """Gibbs sampling of boolean facts; alpha0 and alpha1 are (claims denied, asserted) priors of false and true facts."""
    size, n, v = m.shape
    prior = np.array([alpha0, alpha1], float)
    fact, draws = np.zeros((size, v), int), np.zeros((size, sweeps, v))
    for e, seed in enumerate(seeds):
        rng = np.random.default_rng(seed)
        fact[e] = rng.integers(0, 2, v)
        draws[e] = rng.random((sweeps, v))
    says, at, who = m.astype(int), np.arange(size)[:, None], np.arange(n)[None, :]
    counts = np.zeros((size, n, 2, 2))
    for k in range(v):
        counts[at, who, fact[:, k, None], says[:, :, k]] += 1
    total, kept = np.zeros((size, v)), 0
    for sweep in range(sweeps):
        for k in range(v):
            said = says[:, :, k]
            counts[at, who, fact[:, k, None], said] -= 1
            logp = np.log(np.array([beta[0], beta[1]], float)) + np.zeros((size, 2))
            for side in (0, 1):
                own = np.where(said > 0, counts[:, :, side, 1] + prior[side, 1], counts[:, :, side, 0] + prior[side, 0])
                logp[:, side] += np.log(own / (counts[:, :, side, 0] + counts[:, :, side, 1] + prior[side].sum())).sum(axis=1)
            fact[:, k] = draws[:, sweep, k] < 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -700, 700)))
            counts[at, who, fact[:, k, None], said] += 1
        if sweep >= burn and (sweep - burn) % thin == 0:
            total += fact
            kept += 1
    return total / max(kept, 1)


@many
def em(m: np.ndarray, seeds: list, trust: float = 0.9, history: float = 50.0, tau: float = 0.5, iterations: int = 5, **_) -> np.ndarray:
    size, n, v = m.shape
    draws = np.stack([np.random.default_rng(seed).uniform(1e-9, 1 - 1e-9, (iterations, v)) for seed in seeds])
    votes = m.sum(axis=1)
    ver, given = votes / votes.sum(axis=1, keepdims=True), m.sum(axis=2)
    trust_of = np.full((size, n), trust)
    for i in range(iterations):
        at_least = m @ np.where(ver[:, :, None] >= ver[:, None, :], ver[:, :, None], 0.0)
        pr = (history / (given + history) * trust_of)[:, :, None] + at_least / (given + history)[:, :, None]
        noise = -np.log(-np.log(draws[:, i]))
        soft = np.exp((np.log(np.maximum(ver, 1e-12)) + noise) / tau)
        soft = soft * votes / (soft * votes).sum(axis=1, keepdims=True)
        trust_of = np.clip((pr * soft[:, None, :]).sum(axis=2), 1e-6, 1 - 1e-6)
        p = np.where(m > 0, trust_of[:, :, None], 1 - trust_of[:, :, None])
        share = pr / pr.sum(axis=1, keepdims=True)
        ver = np.exp(np.clip((share * np.log(np.maximum(p * trust_of[:, :, None] / np.maximum(pr, 1e-12), 1e-12))).sum(axis=1), -700, 50))
        ver = ver / np.maximum(ver.max(axis=1, keepdims=True), 1e-12)
    return ver


@many
def case(m: np.ndarray, seeds: list, vectors: list, size: int = 64, same: float = 5.0, different: float = 3.0, rate: float = 0.05, iterations: int = 50, tolerance: float = 1e-5, top: int = 10, **_) -> np.ndarray:
    """Embeds sources and claims: sources near what they claim, and near sources that claim alike; a claim's score is its cosine to the favoured ones."""
    _, n, v = m.shape
    claims, sources = [], []
    for seed, known in zip(seeds, vectors, strict=True):
        rng = np.random.default_rng(seed)
        claims.append(np.stack([np.asarray(x, float) if x is not None else rng.normal(0, 1, size) for x in known]))
        sources.append(rng.normal(0, 0.1, (n, claims[-1].shape[1])))
    if len({x.shape for x in claims}) > 1:  # vectors of several lengths: entities one by one
        rest = {"size": size, "same": same, "different": different, "rate": rate, "iterations": iterations, "tolerance": tolerance, "top": top}
        return np.concatenate([MANY[case](m[e : e + 1], seeds=seeds[e : e + 1], vectors=vectors[e : e + 1], **rest) for e in range(len(m))])
    claim, source = np.stack(claims), np.stack(sources)
    claim /= np.maximum(np.linalg.norm(claim, axis=2, keepdims=True), EPS)
    given = m.sum(axis=2)
    inter = m @ m.transpose(0, 2, 1)
    like = inter / np.maximum(given[:, :, None] + given[:, None, :] - inter, 1)
    pull, push, target = same * like, different * (1 - like), m / given[:, :, None]
    last, settled, left = np.full(len(m), np.inf), source.copy(), np.arange(len(m))
    words = claim
    for i in range(iterations):
        logits = source @ words.transpose(0, 2, 1)
        soft = np.exp(logits - logits.max(axis=2, keepdims=True))
        soft /= soft.sum(axis=2, keepdims=True)
        near = 1 / (1 + np.exp(-np.clip(source @ source.transpose(0, 2, 1), -30, 30)))
        edge = pull * (1 - near) - push * near
        edge[:, np.arange(n), np.arange(n)] = 0
        source = source + rate * ((target - soft) @ words + edge @ source / max(n, 1))
        source /= np.maximum(1.0, np.linalg.norm(source, axis=2, keepdims=True))
        settled[left] = source
        loss = -(target * np.log(np.maximum(soft, EPS))).sum(axis=(1, 2))
        done = np.abs(last - loss) < tolerance if i > 5 else np.zeros(len(left), bool)
        last = loss
        if done.any():
            left, last, source, words, pull, push, target = (x[~done] for x in (left, last, source, words, pull, push, target))
        if not len(left):
            break
    votes = m.sum(axis=1)
    best = np.argsort(-votes, axis=1, kind="stable")[:, :top]
    chosen = np.take_along_axis(claim, best[:, :, None], axis=1)
    weight = np.take_along_axis(votes, best, axis=1) + (settled @ chosen.transpose(0, 2, 1)).sum(axis=1)
    centre = (chosen * np.maximum(weight, EPS)[:, :, None]).sum(axis=1)
    return (claim @ centre[:, :, None])[:, :, 0] / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), EPS)


MODELS: dict[str, Callable] = {"majority": majority, "dart": dart, "truth_finder": truth_finder, "ltm": ltm, "em": em, "case": case}


def register_model(name: str, model: Callable[..., dict[str, float]]) -> None:
    """Add a model: (claims of one entity as pandas, seed=..., options) -> score of each value. One made by :func:`many` runs over many entities at once."""
    MODELS[name] = model


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    told = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary.to_pylist()


def _within(entity: np.ndarray, code: np.ndarray, words: list, entities: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the rank of its word among those of its entity; how many each entity has, where they begin, and a row of each."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (words[i] is not None, words[i]))] = np.arange(len(words))
    pairs, row, back = np.unique(entity * len(words) + rank[code], return_index=True, return_inverse=True)
    size = np.bincount(pairs // len(words), minlength=entities)
    start = np.cumsum(size) - size
    return back - start[entity], size, start, row


def _score(told: pa.Table, starts: np.ndarray, scores: Callable[..., np.ndarray], options: dict) -> pa.RecordBatch:
    """Scores of whole entities, whose rows begin at ``starts``."""
    entity = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, told.num_rows)))
    source, n, _, _ = _within(entity, *_codes(told["source_id"]), len(starts))
    value, v, first, row = _within(entity, *_codes(told["value"]), len(starts))
    shown, found = told.take(pa.array(row)), np.zeros(len(row))
    words = shown["value"].to_pylist()
    vectors = shown["embedding"].to_pylist() if "embedding" in told.column_names else [None] * len(row)
    names = told.take(pa.array(starts))
    seeds = [zlib.crc32(f"{e}|{a}".encode()) for e, a in zip(names["entity"].to_pylist(), names["attribute"].to_pylist(), strict=True)]
    shape = n * (int(v.max()) + 1) + v
    order, place = np.argsort(shape, kind="stable"), np.empty(len(starts), np.int64)
    bounds = np.append(starts, told.num_rows)
    for group in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
        sources, values = int(n[group[0]]), int(v[group[0]])
        step = max(1, ELEMENTS // (sources * values * (sources + values + 64)))
        for at in range(0, len(group), step):
            own = group[at : at + step]
            size = bounds[own + 1] - bounds[own]
            rows = np.repeat(bounds[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place[own] = np.arange(len(own))
            m = np.zeros((len(own), sources, values))
            m[place[entity[rows]], source[rows], value[rows]] = 1
            lists = lambda x: [x[first[e] : first[e] + values] for e in own]
            got = scores(m, values=lists(words), seeds=[seeds[e] for e in own], vectors=lists(vectors), **options)
            found[first[own][:, None] + np.arange(values)] = got
    return pa.RecordBatch.from_arrays([shown[c].combine_chunks() for c in ("entity", "attribute", "value")] + [pa.array(found)], ["entity", "attribute", "value", "score"])


def _streamed(scores: Callable[..., np.ndarray], options: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Claims sorted by entity and attribute in batches; the last entity waits for the next ones."""

    def starts(told: pa.Table) -> np.ndarray:
        e, a = _codes(told["entity"])[0], _codes(told["attribute"])[0]
        return np.append(0, np.flatnonzero((np.diff(e) != 0) | (np.diff(a) != 0)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, fresh = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            fresh += batch.num_rows
            if fresh < ROWS:
                continue
            told = pa.Table.from_batches(waiting)
            begins, fresh = starts(told), 0
            if len(begins) > 1:
                yield _score(told.slice(0, begins[-1]), begins[:-1], scores, options)
            waiting = told.slice(begins[-1]).combine_chunks().to_batches()
        if waiting:
            told = pa.Table.from_batches(waiting)
            yield _score(told, starts(told), scores, options)

    return run


def run_model(claims: DataFrame, model: str, **options) -> DataFrame:
    """``(entity, attribute, value, score)``."""
    cols = ["entity", "attribute", "source_id", "value"]
    real = claims.filter(F.col("value").isNotNull())
    if "embedding" in claims.columns:
        real = real.groupBy(*cols).agg(F.first("embedding").alias("embedding"))
    else:
        real = real.select(*cols).distinct()
    real, schema = real.withColumn("entity", F.col("entity").cast("string")), "entity string, attribute string, value string, score double"
    score = MODELS[model]
    if score in MANY:
        dealt = real.repartition("entity", "attribute").sortWithinPartitions(*(cols if "embedding" in claims.columns else cols[:2]))
        return dealt.withColumn("value", F.col("value").cast("string")).mapInArrow(_streamed(MANY[score], options), schema)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entity, attribute = str(frame["entity"].iloc[0]), frame["attribute"].iloc[0]
        found = score(frame, seed=zlib.crc32(f"{entity}|{attribute}".encode()), **options)
        return pd.DataFrame({"entity": entity, "attribute": attribute, "value": list(found), "score": [float(x) for x in found.values()]})

    return real.groupBy("entity", "attribute").applyInPandas(run, schema)


def truth_finder_sql(claims: DataFrame, iterations: int = 2, trust: float = 0.9, gamma: float = 0.3) -> DataFrame:
    """A fixed number of rounds without implication, over all entities, as joins and aggregations."""
    said = claims.filter(F.col("value").isNotNull()).select("entity", "source_id", "value").distinct()
    now = said.withColumn("t", F.lit(trust))
    for _ in range(iterations):
        sigma = now.groupBy("entity", "value").agg(F.sum(-F.log(1 - F.col("t"))).alias("sigma"))
        ver = sigma.select("entity", "value", (1 / (1 + F.exp(-gamma * F.col("sigma")))).alias("score"))
        both = said.join(ver, ["entity", "value"])
        t = both.groupBy("entity", "source_id").agg(F.greatest(F.least(F.avg("score"), F.lit(1 - 1e-12)), F.lit(1e-12)).alias("t"))
        now = said.join(t, ["entity", "source_id"])
    return ver
