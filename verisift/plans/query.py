"""Queries as small graphs of steps, compiled to one lazy DataFrame each.

A step finds entities by a condition and reads a target attribute, which is
fused.  Its entities may be those of an earlier step's true view (``base``), and
its condition values may come from one (``id-N``).  Entities are restricted
before fusing, so a query only fuses what it asks about.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import DATE_KINDS, OPERATIONS
from verisift.operators import models
from verisift.operators.fusion import alignment_failures, extract_answers, failure_classes, fuse, fuse_aligned, passthrough
from verisift.operators.retrieve import aggregate_view, any_of, bind_columns, filter_fused


@dataclass(frozen=True)
class Step:
    target: str
    condition: str = ""
    values: tuple = ()
    op: str | None = None
    base: int = -1
    function: str = ""

    @classmethod
    def read(cls, raw: dict) -> Step:
        value = raw.get("condition_value")
        if isinstance(value, str) and value.startswith("["):
            value = json.loads(value)
        values = tuple(value) if isinstance(value, list) else () if value in (None, "") else (value,)
        target = raw.get("target_value") or ""
        return cls(raw["target_attribute"], raw.get("condition_attribute") or "", values, raw.get("operator"), int(raw.get("IntermediateResult", -1)), target if target.startswith("Function_") else "")

    @property
    def refers(self) -> int | None:
        """The earlier step whose values are the condition."""
        v = self.values[0] if len(self.values) == 1 else None
        return int(v[3:]) if isinstance(v, str) and v.startswith("id-") and v[3:].isdigit() else None


@dataclass(frozen=True)
class Query:
    id: str
    steps: tuple[Step, ...]
    question: str = ""

    @classmethod
    def read(cls, raw: dict) -> Query:
        return cls(str(raw.get("questionId", raw.get("qid"))), tuple(Step.read(s) for s in raw["subquery"]), raw.get("question", ""))


def levels(steps: tuple[Step, ...]) -> list[list[int]]:
    """Steps in topological levels by what they refer to."""
    needs = {i: {x for x in (s.base, s.refers) if x is not None and x >= 0} for i, s in enumerate(steps)}
    out: list[list[int]] = []
    done: set[int] = set()
    while len(done) < len(steps):
        ready = [i for i in needs if i not in done and needs[i] <= done]
        if not ready:
            raise ValueError("steps refer to each other in a circle")
        out.append(ready)
        done |= set(ready)
    return out


@dataclass
class Engine:
    """Answers queries over claims (entity, attribute, source_id, row_id, value).

    ``mode``: ``system`` fuses the queried entities with confidences and copying,
    ``baseline`` with a classical model, ``batch`` fuses all entities first.
    """

    claims: DataFrame
    key: str = "entity"
    confidence: DataFrame | None = None
    copying: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    multiple: frozenset[str] = frozenset()
    mode: str = "system"
    model: str = "truth_finder"
    propose: Callable[[list], list[list[dict]]] | None = None
    parse: Callable[[str], list[dict]] | None = None
    rules: dict[str, list[list[dict]]] = field(default_factory=dict)
    columns: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    penalise: bool = True

    def ask(self, question: str, id: str = "0") -> DataFrame:
        """The answer to a question that ``parse`` turns into steps."""
        if self.parse is None:
            raise ValueError("no parser of questions")
        return self.run(Query.read({"questionId": id, "question": question, "subquery": self.parse(question)}))

    def learn_rules(self, attribute: str) -> list[list[dict]]:
        """Show the classes of values that failed to align to ``propose`` and keep the rules it returns; only known operations are taken."""
        view = self._fused(attribute, None)
        classes = failure_classes(alignment_failures(view)).select("values").collect()  # five pairs for each pair of sources
        found = self.propose([list(r["values"]) for r in classes]) if self.propose and classes else []
        unknown = {s["op"] for r in found for s in r} - set(OPERATIONS)
        if unknown:
            raise ValueError(f"unknown operations {sorted(unknown)}")
        self.rules[attribute] = [*self.rules.get(attribute, []), *found]
        return found

    def _rows(self, attribute: str) -> DataFrame:
        """The claims of an attribute: by its name, or by the column that is nearest to it in each source."""
        if self.columns is None or self.embed is None:
            return self.claims.filter(F.col("attribute") == attribute)
        asked = self.claims.sparkSession.createDataFrame([([float(x) for x in self.embed(attribute)],)], "embedding array<double>")
        bound = bind_columns(asked, self.columns).select("source_id", F.col("column_name").alias("attribute"))
        return self.claims.join(bound, ["source_id", "attribute"], "left_semi").withColumn("attribute", F.lit(attribute))

    def _fused(self, attribute: str, entities: DataFrame | None) -> DataFrame:
        rows = self._rows(attribute)
        if entities is not None and self.mode != "batch":
            rows = rows.join(entities, "entity", "left_semi")
        if self.mode == "decompose":
            out = passthrough(rows)
        elif self.mode == "baseline" or self.mode == "batch" and self.model:
            scored = rows.join(models.run_model(rows, self.model), ["entity", "attribute", "value"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
            out = extract_answers(scored, attribute in self.multiple, tie_in=self.mode != "batch")
        elif self.rules.get(attribute) or self.kinds.get(attribute) in DATE_KINDS:
            out = fuse_aligned(rows, self.kinds.get(attribute, "general"), self.rules.get(attribute), self.confidence, self.copying, attribute in self.multiple, self.penalise)
            out = out.select(*rows.columns, "score", "is_true")
        else:
            out = fuse(rows, self.confidence, self.copying, self.kinds.get(attribute, "general"), attribute in self.multiple, self.penalise)
        if entities is not None and self.mode == "batch":
            out = out.join(entities, "entity", "left_semi")
        return out

    def _entities(self, step: Step, views: dict[int, DataFrame]) -> DataFrame | None:
        base = views[step.base].filter("is_true").select("entity").distinct() if step.base >= 0 else None
        if not step.condition or not step.values:
            return base
        if step.refers is not None:
            wanted = views[step.refers].filter("is_true").select(F.col("value").alias("_v")).distinct()
            if step.condition == self.key:
                found = wanted.select(F.col("_v").alias("entity"))
            else:
                found = self._fused(step.condition, base).filter("is_true").join(wanted, F.col("value") == F.col("_v"), "left_semi").select("entity").distinct()
        elif step.condition == self.key:
            found = self.claims.filter(any_of(F.col("entity"), step.op, list(step.values))).select("entity").distinct()
        else:
            hit = self.claims.filter(F.col("attribute") == step.condition)
            near = filter_fused(hit, list(step.values), step.op).select("entity").distinct()
            if base is not None:
                near = near.join(base, "entity", "left_semi")
            # a row that says so brings the entity in; whether it is true is for fusion to tell
            found = filter_fused(self._fused(step.condition, near).filter("is_true"), list(step.values), step.op).select("entity").distinct()
        return found if base is None else found.join(base, "entity", "left_semi")

    def run(self, query: Query) -> DataFrame:
        """The last step's view: (entity, attribute, source_id, row_id, value, score, is_true)."""
        views: dict[int, DataFrame] = {}
        for level in levels(query.steps):
            for i in level:
                step = query.steps[i]
                views[i] = self._fused(step.target, self._entities(step, views))
        last = query.steps[-1]
        out = views[len(query.steps) - 1]
        return aggregate_view(out.filter("is_true"), last.function) if last.function else out


def merge_queries(a: dict, b: dict) -> dict:
    """Two one-step queries as one over both entities; shared gold rows are an error."""
    sa, sb = a["subquery"][0], b["subquery"][0]
    if (sa["condition_attribute"], sa["target_attribute"]) != (sb["condition_attribute"], sb["target_attribute"]):
        raise ValueError("the queries ask different things")
    both: dict = {}
    for ts in sorted(set(a.get("answer_view", {})) | set(b.get("answer_view", {}))):
        both[ts] = {}
        for side in ("true_answer", "false_answer"):
            x, y = (q.get("answer_view", {}).get(ts, {}).get(side, {}) for q in (a, b))
            if any(set(x.get(s, [])) & set(y.get(s, [])) for s in x):
                raise ValueError("a row answers both queries")
            both[ts][side] = {s: [*x.get(s, []), *y.get(s, [])] for s in {**x, **y}}
    step = {**sa, "condition_value": [sa["condition_value"], sb["condition_value"]]}
    return {"questionId": f"{a['questionId']}_{b['questionId']}", "question": f"{a.get('question', '')} {b.get('question', '')}".strip(), "answers": [*a.get("answers", []), *b.get("answers", [])], "subquery": [step], "answer_view": both}


def query_pairs(ids: list, n: int, seed: int = 42) -> list[tuple]:
    """``n`` different pairs of ids, drawn with a seed."""
    import random

    ids, rng, out = sorted(ids), random.Random(seed), set()
    n = min(n, len(ids) * (len(ids) - 1) // 2)
    while len(out) < n:
        out.add(tuple(sorted(rng.sample(ids, 2))))
    return sorted(out)
