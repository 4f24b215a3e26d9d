"""Impact of many corruptions on a scorer, and on a schema, in one job.

The plain way is a loop: corrupt a copy of the test data, score it, repeat.  Here every
(corruption, repetition) is one small record.  Each test row looks up the records that hit
it where it lies, and is copied for these alone: the copies are rewritten, scored again,
and turned into a signed change (minus the old score, plus the new one) of the clean
result.  So the cost is one pass over the test rows plus work in proportion to the damaged
rows, and the plan does not grow with the number of repetitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnish.operators.corrupt import (
    PARAMETER_FIELDS, CategoricalShift, Corruption, MissingByConfidence, column_spread, is_number,
    join_confidence, parameters, permutations, wider, with_target,
)
from tarnish.operators.image import ImageCorruption
from tarnish.operators.metrics import (
    confusion, macro_f1, macro_f1_of, score_histogram, shifted_auc, squared_error, task_metric, unscored,
)
from tarnish.operators.ranks import json_literal, literal_rows
from tarnish.operators.sampling import NONE, KeyedTable, RowRules
from tarnish.operators.schema import (
    ANOMALY_DDL, Schema, anomaly_array, cell_flags, infer_schema, type_class, validate,
)
from tarnish.operators.scoring import Scorer
from tarnish.plans.task import Task
from tarnish.session import cut_lineage, jit_sized

INFO_DDL = ("idx int, scenario_id int, rep int, corruption string, kind string, `column` string, "
            "fraction double, sampling string, scorable boolean, mismatch array<string>")


@dataclass(frozen=True)
class Scenario:
    idx: int
    scenario_id: int
    rep: int
    seed: str
    corruption: Corruption


@dataclass
class Prepared:
    """Everything about a grid that does not depend on the scorer."""

    scenarios: list[Scenario]
    rules: RowRules
    spreads: dict[str, float | None]
    kinds: dict[str, T.DataType]
    scorable: list[bool]

    @property
    def active(self) -> list[Scenario]:
        return [s for s in self.scenarios
                if self.scorable[s.idx] and self.rules.rules[s.idx].mode != NONE]


class ConfidenceLanes:
    """A column per scorer, and per table it predicts on, that ranks the test rows by confidence.

    A corruption without a scorer takes the evaluator's.  The predicted table holds another
    version of the test rows; it is joined by key once.
    """

    def __init__(self, task: Task, scorer: Scorer):
        self.task, self.scorer = task, scorer
        self.pairs: list[tuple[Scorer, DataFrame | None]] = []

    def assign(self, c: Corruption) -> Corruption:
        if not isinstance(c, MissingByConfidence):
            return c
        pair = (c.scorer or self.scorer, c.predict_on)
        known = [i for i, p in enumerate(self.pairs) if p[0] is pair[0] and p[1] is pair[1]]
        if not known:
            self.pairs.append(pair)
        return replace(c, lane=f"_confidence{known[0] if known else len(self.pairs) - 1}")

    def ranked(self) -> DataFrame:
        """The test rows with all lanes; the rows of a predicted table must be those of the test."""
        task, out = self.task, self.task.test
        for i, (scorer, other) in enumerate(self.pairs):
            lane = f"_confidence{i}"
            if other is None:
                out = scorer.score(out, "_s").withColumn(lane, scorer.confidence("_s")).drop("_s")
            else:
                out = join_confidence(out, scorer, other, task.key, lane)
        if any(other is not None for _, other in self.pairs):
            out = cut_lineage(out)
            if out.count() != task.test_rows:
                raise ValueError("predict_on repeats a key")
        return out


class ImpactEvaluator:
    """Scores a grid of corruptions, each repeated with fresh draws."""

    def __init__(self, task: Task, scorer: Scorer, schema: Schema | None = None):
        self.task, self.scorer, self.schema = task, scorer, schema
        jit_sized(task.test.sparkSession)  # damaging, scoring and folding a row are one stage

    # -- public -----------------------------------------------------------------------

    def evaluate(self, corruptions: Sequence[Corruption], repetitions: int = 10) -> DataFrame:
        """One row per corruption and repetition with the clean and the damaged score.

        Corruptions that say which rows they hit and what the cells become (all of this
        library, images included) share one job.  Any other object with ``transform(df,
        key, seed)`` is applied to the whole test table, one scan per repetition.  A score
        is NULL where the scorer gives a labelled row none.
        """
        return self._scored(*self._split(corruptions), repetitions, {None: self.scorer})

    def compare(self, scorers: dict[str, Scorer], corruptions: Sequence[Corruption],
                repetitions: int = 10) -> DataFrame:
        """The same damaged rows scored by several models, told apart by ``model_id``."""
        return self._scored(*self._split(corruptions), repetitions, scorers)

    def _split(self, corruptions: Sequence) -> tuple[dict[int, Corruption], dict[int, object]]:
        """Corruptions by number: those described by rules, and the user's own transformations."""
        ruled = {i: c for i, c in enumerate(corruptions) if _has_rules(c)}
        return ruled, {i: c for i, c in enumerate(corruptions) if i not in ruled}

    def _scored(self, ruled: dict, own: dict, repetitions: int, scorers: dict) -> DataFrame:
        results = self._results(self.prepare(ruled, repetitions), list(scorers.values())) if ruled else []
        parts = []
        for i, (name, scorer) in enumerate(scorers.items()):
            found = results[i:i + 1]
            found += [self._transformed(own, repetitions, scorer)] if own else []
            parts += [df if name is None else df.withColumn("model_id", F.lit(name)) for df in found]
        if not parts:
            raise ValueError("no corruption given")
        return reduce(DataFrame.unionByName, parts)

    def damage_counts(self, p: Prepared) -> DataFrame:
        """How many test rows each scenario damages."""
        hits = self._damaged(p).groupBy(F.col("s.idx").alias("idx")).agg(F.count(F.lit(1)).alias("_n"))
        return self._info(p).join(hits, "idx", "left").withColumn("rows_hit", F.coalesce("_n", F.lit(0))).drop("_n")

    def prepare(self, corruptions: Sequence[Corruption] | dict[int, Corruption], repetitions: int) -> Prepared:
        task, schema = self.task, self.task.test.schema
        scenarios, lanes = [], ConfidenceLanes(task, self.scorer)
        for sid, c in corruptions.items() if isinstance(corruptions, dict) else enumerate(corruptions):
            bound = lanes.assign(c.bind(task.features, f"{task.seed}/{sid}"))
            absent = [x for x in bound.affected() if x not in task.features]
            if absent:
                raise ValueError(f"not a feature of the task: {absent}")
            scenarios += [Scenario(len(scenarios) + r, sid, r, f"{task.seed}/{sid}/{r}", bound)
                          for r in range(repetitions)]
        table = KeyedTable(lanes.ranked(), task.key, task.seed, rows=task.test_rows)
        rules = RowRules(table, [s.corruption.draw(s.seed, task.features) for s in scenarios])
        kinds: dict[str, T.DataType] = {}
        scorable = []
        for s in scenarios:
            after = s.corruption.types(schema)
            fits = all(is_number(k) == is_number(schema[c].dataType) for c, k in after.items())
            scorable.append(fits or rules.rules[s.idx].mode == NONE)
            for c, k in after.items() if fits else ():
                kinds[c] = wider(kinds.get(c, schema[c].dataType), k)
        noisy = sorted({s.corruption.column for s in scenarios if s.corruption.needs_spread})
        return Prepared(scenarios, rules, column_spread(task.test, noisy), kinds, scorable)

    # -- the batched job --------------------------------------------------------------

    def _damaged(self, p: Prepared, scorers: Sequence[Scorer] = ()) -> DataFrame:
        """The rows hit by each scenario, still with their old cells; ``s`` is the scenario.

        A row also carries the clean score of each given scorer, computed once before it is
        paired with scenarios.
        """
        groups: dict[tuple, int] = {}
        records: list[dict | None] = [None] * len(p.scenarios)
        for s in p.active:
            g = groups.setdefault(_rewrite_key(s.corruption), len(groups))
            records[s.idx] = {"idx": s.idx, "g": g} | parameters(s.corruption, s.seed, p.spreads.get(s.corruption.column))
        rows = p.rules.table.df
        for i, scorer in enumerate(scorers):
            rows = scorer.score(rows, f"_old{i}")
        hit = p.rules.paired(rows, "_i", {s.idx for s in p.active})
        of = json_literal(records, f"array<struct<idx:int,g:int,{PARAMETER_FIELDS}>>")
        hit = hit.withColumn("s", F.get(of, "_i")).drop("_i")
        return self._with_targets(hit, p)

    def _with_targets(self, hit: DataFrame, p: Prepared) -> DataFrame:
        """Look up the permuted category of rows under a categorical shift."""
        shifts = [s for s in p.active if isinstance(s.corruption, CategoricalShift)
                  and not is_number(self.task.test.schema[s.corruption.column].dataType)]
        if not shifts:
            return hit.withColumn("_target", F.lit(None).cast("string"))
        pairs, wanted = [], None
        for column in sorted({s.corruption.column for s in shifts}):
            of = [s for s in shifts if s.corruption.column == column]
            seeds = [(s.idx, s.seed, s.corruption.derange) for s in of]
            pairs.append(permutations(self.task.test, column, seeds))
            test = F.col("s.idx").isin([s.idx for s in of])
            wanted = F.when(test, F.col(column)) if wanted is None else wanted.when(test, F.col(column))
        table = reduce(DataFrame.unionByName, pairs).select(
            F.col("id").alias("_id"), F.col("value").alias("_value"), F.col("target").alias("_target"))
        return with_target(hit, table, wanted, F.col("_k"), [(F.col("s.idx"), "_id")]).drop("_id")

    def _rewritten(self, p: Prepared, scorers: Sequence[Scorer], moves: dict[str, Column]) -> DataFrame:
        """Damaged rows with their new cells, all read from the old row at once.

        ``moves`` are expressions over the old row that go along.
        """
        new = _new_cells(p, self.task.test.schema)
        names = ["idx", *self.task.test.columns, *[f"_old{i}" for i in range(len(scorers))]]
        cells = [F.col("s.idx").alias("idx"), *[new[c].alias(c) if c in new else F.col(c) for c in names[1:]],
                 *[e.alias(n) for n, e in moves.items()]]
        batched: dict[tuple, ImageCorruption] = {
            _rewrite_key(s.corruption): s.corruption for s in p.active if _in_batches(s.corruption)}
        if not batched:
            return self._damaged(p, scorers).select(*cells)
        parts, damaged = [], self._damaged(p, scorers)
        of = {k: [s.idx for s in p.active if _rewrite_key(s.corruption) == k] for k in batched}
        rest = [s.idx for s in p.active if not _in_batches(s.corruption)]
        if rest:
            parts.append(damaged.where(F.col("s.idx").isin(rest)).select(*cells))
        for key, c in batched.items():
            hit = damaged.where(F.col("s.idx").isin(of[key])).withColumns(
                {"idx": F.col("s.idx"), "_hit": F.lit(True), "_stream": F.col("s.stream")})
            # a checkpointed task has ``_v`` among its columns already
            plain = [n for n in names if n not in ("_v", "_k")]
            done = c.in_batches(hit, plain)
            parts.append(done.select(*[F.col(n) if n in plain else F.lit(None).cast(hit.schema[n].dataType).alias(n)
                                       for n in names], *[F.lit(0).alias(n) for n in moves]))
        return reduce(DataFrame.unionByName, parts)

    # -- the user's own transformations -----------------------------------------------

    def _transformed(self, own: dict[int, object], repetitions: int, scorer: Scorer) -> DataFrame:
        task = self.task
        columns = [c for c in task.test.columns if c not in ("_k", "_v")]
        test = task.test.select(*columns)
        runs = [(sid * repetitions + r, sid, r, c) for sid, c in own.items() for r in range(repetitions)]
        scored, seen, rows = [], [], []
        for idx, sid, rep, c in runs:
            damaged = c.transform(test, task.key, f"{task.seed}/{sid}/{rep}")
            absent = [n for n in (*task.key, task.label) if n not in damaged.columns]
            if absent:
                raise ValueError(f"{c!r} drops the columns {absent}")
            scored.append(scorer.score(damaged, "_score").select(F.lit(idx).alias("idx"), task.label, "_score"))
            if self.schema is not None:
                found = validate(damaged.select(*[n for n in damaged.columns if n in task.features or n not in columns]),
                                 self.schema)
                seen.append(found.select(F.lit(idx).alias("idx"), F.struct("column", "code", "observed", "expected").alias("a")))
            name = c.describe() if hasattr(c, "describe") else type(c).__name__
            rows.append(_info_row(idx, sid, rep, name, c, True, []))
        info = literal_rows(test.sparkSession, rows, INFO_DDL)
        whole = reduce(DataFrame.unionByName, scored)
        scores = task_metric(whole, task.task_type, "_score", task.label, ["idx"], "corrupted_score", task.positive_class)
        counts = whole.groupBy("idx").agg(F.count(F.lit(1)).alias("_n"))
        wrong = F.raise_error(F.lit("a corruption changed the number of test rows")).cast("double")
        out = info.join(scores, "idx", "left").join(counts, "idx", "left").withColumn(
            "corrupted_score", F.when(F.coalesce("_n", F.lit(0)) == task.test_rows, F.col("corrupted_score")).otherwise(wrong))
        out = out.withColumn("baseline_score", F.lit(task.performance(scorer).first()[0]).cast("double"))
        names = [*RESULT, "baseline_score", "corrupted_score"]
        if self.schema is None:
            return out.select(*names)
        found = reduce(DataFrame.unionByName, seen).groupBy("idx").agg(F.sort_array(F.collect_list("a")).alias("anomalies"))
        none = F.array().cast(found.schema["anomalies"].dataType)
        out = out.join(found, "idx", "left").withColumn("anomalies", F.coalesce("anomalies", none))
        return out.select(*names, (F.size("anomalies") > 0).alias("anomaly_detected"), "anomalies")

    def _results(self, p: Prepared, scorers: list[Scorer]) -> list[DataFrame]:
        """One result per scorer, all from the same damaged rows."""
        info, task = self._info(p), self.task
        changes, moves = None, {}
        if p.active:
            moves = self._flag_moves(p) if self.schema is not None else {}
            changes = self._changes(p, scorers, moves)
        if self.schema is not None:
            info = self._anomalies(p, info, changes, moves)
        columns = [*RESULT, "baseline_score",
                   F.when(F.col("scorable"), F.col("corrupted_score")).alias("corrupted_score")]
        if self.schema is not None:
            columns += [(F.size("anomalies") > 0).alias("anomaly_detected"), F.col("anomalies")]
        metric = {"binary": self._auc, "multiclass": self._f1, "regression": self._error}[task.task_type]
        results = []
        for i, scorer in enumerate(scorers):
            if changes is not None:
                both = changes.select("idx", task.label, F.col(f"_old{i}").alias("_old"), F.col(f"_new{i}").alias("_new"))
                measured = metric(p, scorer, both)
            else:
                clean = F.lit(task.performance(scorer, "baseline_score").first()[0]).cast("double")
                measured = info.select("idx", clean.alias("baseline_score"), clean.alias("corrupted_score"))
            results.append(info.join(measured, "idx", "left").select(*columns))
        return results

    def _info(self, p: Prepared) -> DataFrame:
        rows = []
        for s in p.scenarios:
            c, changed = s.corruption, []
            if p.rules.rules[s.idx].mode != NONE:
                after = c.types(self.task.test.schema)
                changed = [n for n, k in after.items()
                           if type_class(k) != type_class(self.task.test.schema[n].dataType)]
            rows.append(_info_row(s.idx, s.scenario_id, s.rep, c.describe(), c, p.scorable[s.idx], changed))
        return literal_rows(self.task.test.sparkSession, rows, INFO_DDL)

    # -- metrics from signed changes --------------------------------------------------

    def _changes(self, p: Prepared, scorers: list[Scorer], moves: dict[str, Column]) -> DataFrame:
        """(idx, label, old and new score by each scorer, moved flags) of every damaged row.

        Where more than one result is read off, these narrow rows are written once.
        """
        rows = self._rewritten(p, scorers, moves)
        for i, scorer in enumerate(scorers):
            rows = scorer.score(rows, f"_new{i}")
        scores = [f"_{side}{i}" for i in range(len(scorers)) for side in ("old", "new")]
        rows = rows.select("idx", self.task.label, *scores, *moves)
        return cut_lineage(rows) if len(scorers) > 1 or moves else rows

    def _signed(self, both: DataFrame) -> DataFrame:
        """Each changed score twice: the old one with -1 and the new one with +1."""
        both = both.where(~F.col("_old").eqNullSafe(F.col("_new")))
        sides = F.array(F.struct(F.col("_old").alias("x"), F.lit(-1).alias("w")),
                        F.struct(F.col("_new").alias("x"), F.lit(1).alias("w")))
        return both.withColumn("e", F.explode(sides)).select(
            "idx", self.task.label, F.col("e.x").alias("_score"), F.col("e.w").alias("_w"))

    def _auc(self, p: Prepared, scorer: Scorer, both: DataFrame) -> DataFrame:
        label, positive = self.task.label, self.task.positive_class
        clean = score_histogram(scorer.score(self.task.test, "_score"), "_score", label, positive=positive)
        delta = score_histogram(self._signed(both), "_score", label, ["idx"], F.col("_w"), positive)
        labelled = self.task.test.agg(F.count(label)).first()[0]
        return shifted_auc(clean, delta, len(p.scenarios), labelled).select(
            "idx", F.col("clean_score").alias("baseline_score"), F.col("shifted_score").alias("corrupted_score"))

    def _f1(self, p: Prepared, scorer: Scorer, both: DataFrame) -> DataFrame:
        label = self.task.label
        scored = scorer.score(self.task.test, "_score")
        everyone = F.sequence(F.lit(0), F.lit(len(p.scenarios) - 1))
        clean = confusion(scored, "_score", label)
        delta = confusion(self._signed(both), "_score", label, ["idx"], F.col("_w"))
        counts = (
            clean.withColumn("idx", F.explode(everyone)).unionByName(delta)
            .groupBy("idx", "label", "prediction").agg(F.sum("n").alias("n"))
        )
        base = macro_f1(scored, "_score", label).first()[0]
        return macro_f1_of(counts, ["idx"], "corrupted_score").withColumn("baseline_score", F.lit(base))

    def _error(self, p: Prepared, scorer: Scorer, both: DataFrame) -> DataFrame:
        label = self.task.label
        clean = scorer.score(self.task.test, "_score").agg(
            F.sum(squared_error("_score", label)).alias("total"), F.count(label).alias("n"),
            F.count_if(unscored("_score", label)).alias("blank")).first()
        change = both.groupBy("idx").agg(
            F.sum(F.coalesce(squared_error("_new", label), F.lit(0.0))
                  - F.coalesce(squared_error("_old", label), F.lit(0.0))).alias("change"),
            (F.count_if(unscored("_new", label)) - F.count_if(unscored("_old", label))).alias("blank"))
        every = self.task.test.sparkSession.range(len(p.scenarios)).select(F.col("id").cast("int").alias("idx"))
        moved = every.join(change, "idx", "left")
        total, n = F.lit(clean["total"]), F.lit(float(clean["n"]))
        blank = F.lit(clean["blank"])
        return moved.select(
            "idx", F.when(blank == 0, total / n).alias("baseline_score"),
            F.when(blank + F.coalesce("blank", F.lit(0)) == 0, (total + F.coalesce("change", F.lit(0.0))) / n)
            .alias("corrupted_score"))

    # -- schema anomalies from signed changes -----------------------------------------

    def _known(self) -> list:
        return [e for e in self.schema.expectations if e.column in self.task.test.columns]

    def _anomalies(self, p: Prepared, out: DataFrame, changes: DataFrame | None, moves: dict[str, Column]) -> DataFrame:
        test, schema = self.task.test, self.schema
        known = self._known()
        fixed = [(e.column, "MISSING_COLUMN", 0.0, 1.0) for e in schema.expectations if e.column not in test.columns]
        fixed += [(c, "NEW_COLUMN", 1.0, 0.0) for c in self.task.features if c not in schema]
        clean = test.agg(F.count(F.lit(1)).alias("rows"), *[
            F.count_if(flag).alias(f"{name}{i}") for i, e in enumerate(known)
            for name, flag in cell_flags(e, test.schema[e.column].dataType, F.col(e.column)).items()
        ]).first()
        if moves:
            moved = changes.groupBy("idx").agg(*[F.sum(n).cast("bigint").alias(n) for n in moves])
            out = out.join(moved, "idx", "left")
        arrays = [json_literal([dict(zip(("column", "code", "observed", "expected"), f)) for f in fixed],
                               f"array<struct<{ANOMALY_DDL.replace(' ', ':').replace(',:', ',')}>>")]
        for i, e in enumerate(known):
            counts = []
            for name in ("gone", "odd", "far"):
                count = F.lit(clean[f"{name}{i}"]).cast("bigint")
                if f"_{name}{i}" in moves:
                    count = count + F.coalesce(F.col(f"_{name}{i}"), F.lit(0))
                counts.append(count)
            same = F.lit(type_class(test.schema[e.column].dataType) == e.type)
            same = same & ~F.array_contains("mismatch", e.column)
            arrays.append(anomaly_array(e, F.lit(clean["rows"]).cast("bigint"), *counts, same))
        return out.withColumn("anomalies", F.flatten(F.array(*arrays)))

    def _flag_moves(self, p: Prepared) -> dict[str, Column]:
        """How a damaged row moves the counts of missing, odd and far cells of its columns."""
        before, moves = self.task.test.schema, {}
        new = _new_cells(p, before)
        for i, e in enumerate(self._known()):
            if e.column not in new:
                continue
            old_flags = cell_flags(e, before[e.column].dataType, F.col(e.column))
            new_flags = cell_flags(e, p.kinds[e.column], new[e.column])
            for name in old_flags:
                moves[f"_{name}{i}"] = new_flags[name].cast("int") - old_flags[name].cast("int")
        return moves


# Columns that say what a row of the result is about.
RESULT = ["scenario_id", "rep", "corruption", "kind", "column", "fraction", "sampling"]


def _info_row(idx: int, sid: int, rep: int, text: str, c: object, scorable: bool, mismatch: list[str]) -> dict:
    about = {name: getattr(c, name, None) for name in ("column", "fraction", "sampling")}
    return {"idx": idx, "scenario_id": sid, "rep": rep, "corruption": text, "kind": type(c).__name__, **about,
            "scorable": scorable, "mismatch": mismatch}


def _has_rules(c: object) -> bool:
    """Does the corruption describe its rows and cells, or has it a transformation of its own?"""
    if isinstance(c, ImageCorruption):
        return True
    return isinstance(c, Corruption) and type(c).transform is Corruption.transform


def _in_batches(c: object) -> bool:
    return isinstance(c, ImageCorruption) and not c.by_expression


def _rewrite_key(c: Corruption) -> tuple:
    """Corruptions that differ only in which rows they hit share one rewriting branch."""
    left_out = ("fraction", "sampling", "most_confident", "compat", "derange")
    return (type(c).__name__, *((k, v) for k, v in sorted(c.spec().items()) if k not in left_out))


def _new_cells(p: Prepared, schema: T.StructType) -> dict[str, Column]:
    """One CASE per affected column, with one branch per distinct way of rewriting it."""
    groups: dict[tuple, tuple[int, Corruption]] = {}
    for s in p.active:
        key = _rewrite_key(s.corruption)
        if key not in groups:
            groups[key] = (len(groups), s.corruption)
    cases: dict[str, Column] = {}
    for g, c in groups.values():
        for column, value in c.values(schema, F.col("s")).items():
            value, test = value.cast(p.kinds[column]), F.col("s.g") == g
            cases[column] = F.when(test, value) if column not in cases else cases[column].when(test, value)
    return {c: e.otherwise(F.col(c).cast(p.kinds[c])) for c, e in cases.items()}


class SchemaEvaluator(ImpactEvaluator):
    """Impact plus the question whether a schema learnt on training data sees the damage."""

    def __init__(self, task: Task, scorer: Scorer, schema: Schema | None = None):
        super().__init__(task, scorer, schema or infer_schema(task.train, task.features))


def grid(make, columns: Sequence[str], fractions: Sequence[float], samplings: Sequence[str], **options) -> list[Corruption]:
    """Every combination of column, fraction and sampling mechanism."""
    return [make(column=c, fraction=f, sampling=m, **options)
            for c in columns for f in fractions for m in samplings]
