"""Insert batches in order of their timestamps, with fusion state kept as tables.

State is one row for each (entity, attribute, key): its history score and
provenance.  A batch touches only the entities it has rows for: their old groups
fade, meet the new ones by key, and are decided anew.  State tables are written,
so a batch can be run again after a failure; a batch that was already taken in
is skipped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.operators.fusion import HISTORY_DECAY, KEEP_DELTA, copy_evidence, group_by_source, merge_history, merge_sources, multi_truth, single_truth, update_copying
from verisift.scratch import discard, materialize, shared_dir

#: A row for each batch taken in: its number and id, and the tables of the state after it.
LOG = "n long, batch string, state string, copying string"
STATE = "entity string, attribute string, key string, value string, score double, n_rows long, n_sources long, first_source string"


class Fusion:
    """Fusion state over batches of claims."""

    def __init__(
        self, spark: SparkSession, kind: str = "general", multiple: bool = False, confidence: DataFrame | None = None, learn_copying: bool = True, log: str | None = None
    ):
        self.spark, self.kind, self.multiple, self.confidence, self.learn_copying, self.log = spark, kind, multiple, confidence, learn_copying, log
        self.state = spark.createDataFrame([], STATE)
        self.copying: DataFrame | None = None
        self.done: set[str] = set()
        self.batches = 0
        if log:
            self._resume()

    def _resume(self) -> None:
        """Go on from the last batch of the log, if there is one."""
        try:
            rows = self.spark.read.schema(LOG).parquet(self.log).orderBy("n").collect()  # a row a batch
        except AnalysisException:
            return
        if rows:
            self.done, self.batches = {r.batch for r in rows if r.batch is not None}, rows[-1].n
            self.state = self._reread(rows[-1].state)
            self.copying = self._reread(rows[-1].copying) if rows[-1].copying else None

    def _reread(self, path: str) -> DataFrame:
        df = self.spark.read.parquet(path)
        df.scratch_path = path
        return df

    def _commit(self, batch_id) -> None:
        """The batch counts from here: its row in the log names the tables to go on from."""
        self.batches += 1
        if batch_id is not None:
            self.done.add(str(batch_id))
        if self.log:
            row = (self.batches, None if batch_id is None else str(batch_id), self.state.scratch_path, getattr(self.copying, "scratch_path", None))
            self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(self.log)

    def add(self, batch: DataFrame, batch_id=None) -> DataFrame:
        """Take in a batch; returns the decided groups of the entities it touches, as a table of its own that later batches leave alone."""
        if batch_id is not None and str(batch_id) in self.done:
            return self.truths()
        batch = batch.withColumn("source_id", F.col("source_id").cast("string")).withColumn("entity", F.col("entity").cast("string"))
        groups = materialize(group_by_source(batch, self.confidence, self.kind), "groups")
        copying = None
        if self.copying is not None:
            copying = self.copying.select("attribute", "s", "t", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("c"))
        delta = merge_sources(groups, copying).select(*(f.split()[0] for f in STATE.split(", ")))
        after = materialize(merge_history(self.state, delta), "state")
        before, self.state = self.state, after
        touched = after.join(groups.select("entity", "attribute").distinct(), ["entity", "attribute"], "left_semi")
        decided = materialize(self._decide(touched), "decided")
        if self.learn_copying:
            told = materialize(update_copying(self.copying, copy_evidence(groups, decided)), "copying")
            self.copying = told
        self._commit(batch_id)
        discard(before)
        return decided

    def _decide(self, groups: DataFrame) -> DataFrame:
        return multi_truth(groups, KEEP_DELTA) if self.multiple else single_truth(groups)

    def truths(self) -> DataFrame:
        return self._decide(self.state)


def replay(events: DataFrame, fusion: Fusion, on_batch: Callable[[int, DataFrame], None] | None = None) -> Fusion:
    """Insert events by timestamp: (timestamp, entity, attribute, source_id, row_id, value). The list of timestamps is the driver's loop."""
    path = f"{shared_dir(fusion.spark)}/events-{uuid.uuid4().hex}"
    events.write.partitionBy("timestamp").parquet(path)  # so that each batch is read alone
    dealt = fusion.spark.read.schema(events.schema).parquet(path)
    for (ts,) in events.select("timestamp").distinct().orderBy("timestamp").collect():
        decided = fusion.add(dealt.filter(F.col("timestamp") == ts), ts)
        if on_batch:
            on_batch(ts, decided)
    return fusion


def stream(source: DataFrame, fusion: Fusion, checkpoint: str):
    """The same as a streaming query: each micro-batch is taken in once, by its number."""
    return source.writeStream.foreachBatch(lambda df, n: fusion.add(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decayed_scores(claims: DataFrame, batch: str = "batch") -> DataFrame:
    """What the state's scores are after all batches, in one pass: each batch's count times the decay of the touches after it."""
    per = claims.groupBy("entity", batch, "value").agg(F.count("*").alias("n"))
    touches = per.select("entity", batch).distinct()
    later = F.count("*").over(W.partitionBy("entity").orderBy(F.desc(batch))) - 1
    faded = per.join(touches.withColumn("later", later), ["entity", batch])
    return faded.groupBy("entity", "value").agg(F.sum(F.col("n") * F.pow(F.lit(HISTORY_DECAY), F.col("later"))).alias("score"))


def delta(claims: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of the queries' entities that are newer than what the query has seen; ``last``: (query_id, entity, batch_ts)."""
    return claims.join(last.withColumnRenamed("batch_ts", "_seen"), "entity").filter(F.col("batch_ts") > F.col("_seen")).drop("_seen")


class QueryCache:
    """Views of queries already answered, by the query's text and the version of the rules.

    A query that was answered before only reads the rows of its entities that
    came since; without any, its view is returned as it is.  New rules change the
    version, so views are fused again from all rows.
    """

    def __init__(self, rules: list | None = None):
        self.rules = rules or []
        self.known: dict[tuple[str, str], tuple[int, DataFrame]] = {}

    def version(self) -> str:
        return hashlib.sha256(json.dumps(self.rules, sort_keys=True).encode()).hexdigest()

    def answer(self, query: str, claims: DataFrame, batch_ts: int, fuse: Callable[[DataFrame, list], DataFrame]) -> DataFrame:
        """The view of ``claims`` (entity, ..., batch_ts) as of ``batch_ts``; ``fuse`` (claims, rules) makes a view with the claims' columns."""
        key = (query, self.version())
        upto = claims.filter(F.col("batch_ts") <= batch_ts)
        if key not in self.known:
            view = materialize(fuse(upto, self.rules), "answer")
        else:
            seen, old = self.known[key]
            fresh = upto.filter(F.col("batch_ts") > seen).select("entity").distinct()
            if fresh.isEmpty():
                self.known[key] = (batch_ts, old)
                return old
            touched = materialize(fresh, "touched")
            again = fuse(upto.join(touched, "entity", "left_semi"), self.rules)
            view = materialize(old.join(touched, "entity", "left_anti").unionByName(again.select(old.columns)), "answer")
        self.known[key] = (batch_ts, view)
        return view


def snapshots(events: DataFrame, key: str = "entity") -> DataFrame:
    """Rows of each key known at each timestamp, as cumulative counts per source."""
    per = events.groupBy(key, "source_id", "timestamp").agg(F.count("*").alias("n"))
    w = W.partitionBy(key, "source_id").orderBy("timestamp")
    return per.select(key, "source_id", "timestamp", F.sum("n").over(w).alias("n_rows"))


def generate_log(records: DataFrame, id_col: str, start: int = 1735689600, batches: int = 100, initial: float = 0.5, seed: int = 42, sources: int | None = None) -> DataFrame:
    """Half of the rows as the initial state (timestamp ``start``), the others in equal batches, by a seeded hash; only the largest sources if asked."""
    if sources is not None:
        top = records.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(sources).select("source_id")
        records = records.join(top, "source_id", "left_semi")
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    late = F.floor((draw - initial) / (1 - initial) * batches).cast("long") + 1
    return records.withColumn("timestamp", F.lit(start) + F.when(draw < initial, F.lit(0)).otherwise(late)).withColumn("type", F.lit("insert"))
