"""T-1: run every permitted candidate of every dataset from one scan of the source.

A plan's trim and marker steps between two de-duplications are a pair of column
lists: marking tests the stripped text, so both orders of the two actions give the
same cell. What a plan does is therefore an array of such pairs, one more than it
has de-duplications, and travels with its dataset as data.

* Plans that keep all rows are **column variants of one row**. Stripping and the
  patterns of a cell are worked out once; a variant only changes whether the cell is
  present. One aggregate per dataset counts the kinds of cells of each column, of
  which every variant's counts follow (no copy of a row per candidate), sums the
  variants' fingerprint limbs, and sums the source's own limbs, which must give the
  audited fingerprint: the trials read what was audited. Duplicate counts shuffle one
  digest per row and variant.
* Plans that drop rows are grouped by the row itself (``min`` of the row id, combined
  map-side) and their outputs written once.

Both parts are audited by the same rules. No plan that policy, batch rules or the
execution gate hold back reads a row. A candidate that can't run has an ``error`` in
place of a failing job; a source that changed after its audit, or while the trials
ran, makes all trials of its dataset SOURCE_CHANGED.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import cut
from .audit import N_LIMBS, AuditResult, assemble, audit, fingerprint_of, limb_words, limbs, qcol, signature
from .policy import PLAN_KEYS, authorize, batch_violations, execution_gate, plan_hashes, plan_violations

ROW_ID = "_row_id"
_SEGMENT = "struct<trim:array<string>,mark:array<string>>"


@dataclass
class TrialResult:
    plan_decisions: DataFrame
    action_decisions: DataFrame
    trials: DataFrame          # dataset_id, candidate_id, status, error, output_fingerprint, plan_hash
    after: AuditResult         # keyed by (dataset_id, candidate_id), only executed trials
    rows: Callable[[], DataFrame]

    @property
    def outputs(self) -> DataFrame:
        """Repaired rows of the executed trials (lazy)."""
        return self.rows()


# ------------------------------------------------------------------ what may run

def action_errors(plan_actions: DataFrame, columns: list[str]) -> DataFrame:
    """``PLAN_KEYS, executable, error``: why a plan's actions can't run on these columns (first in step order)."""
    known = F.array(*[F.lit(c) for c in columns])
    asks, named = F.col("action"), F.size("columns") > 0
    error = (F.when((asks == "REMOVE_EXACT_DUPLICATES") & named, "ROWS_TAKE_NO_COLUMNS")
             .when((asks == "STANDARDIZE_MISSING_MARKERS") & ~named, "COLUMNS_REQUIRED")
             .when(F.size(F.array_except("columns", known)) > 0, "UNKNOWN_COLUMN"))
    return plan_actions.groupBy(*PLAN_KEYS).agg(
        F.bool_and(asks.isin(*K.EXECUTABLE_ACTIONS)).alias("executable"),
        F.min_by(error, F.when(error.isNotNull(), F.col("action_idx"))).alias("error"))


def trial_status(plan_decisions: DataFrame, action_decisions: DataFrame, plans: DataFrame, plan_actions: DataFrame,
                 columns: list[str], current: DataFrame) -> DataFrame:
    """``PLAN_KEYS, status, error`` before execution; ``RUN`` where nothing holds the plan back.

    BATCH_INVALID (V1/V2) covers all candidates of a dataset; then policy, support,
    the execution gate (V7) against ``current(dataset_id, fingerprint)``, and the columns.
    """
    broken = plan_violations(plans, plan_actions).unionByName(batch_violations(plans, plan_actions))
    broken = broken.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("violation")), ",").alias("broken"))
    gate = execution_gate(plans, plan_actions, plan_decisions, action_decisions, current)
    j = (plans.select(*PLAN_KEYS).distinct().join(plan_decisions.select(*PLAN_KEYS, "status", "can_execute"), PLAN_KEYS, "left")
         .join(action_errors(plan_actions, columns), PLAN_KEYS, "left")
         .join(gate.select(*PLAN_KEYS, F.array_join("failed_checks", ",").alias("checks")), PLAN_KEYS, "left")
         .join(broken, "dataset_id", "left"))
    permitted = F.coalesce((F.col("status") == "APPROVED") & F.col("can_execute"), F.lit(False))
    supported = F.coalesce("executable", F.lit(True))
    error = F.coalesce(F.nullif("checks", F.lit("")), F.col("error"))
    status = (F.when(F.col("broken").isNotNull(), "BATCH_INVALID")
              .when(~permitted, F.when(F.col("status") == "DENIED", "DENIED").otherwise("REQUIRES_REVIEW"))
              .when(~supported, "UNSUPPORTED").when(error.isNotNull(), "TRIAL_FAILED").otherwise("RUN"))
    return j.select(*PLAN_KEYS, status.alias("status"), F.when(F.col("broken").isNotNull(), F.col("broken"))
                    .when(permitted & supported, error).alias("error"))


# ------------------------------------------------------------------ what plans do

@dataclass
class Programs:
    plans: DataFrame   # PLAN_KEYS, segments, slot (number among the dataset's row-keeping plans, else null)
    slots: int         # row-keeping plans of the dataset with most of them (the batch rule bounds it)
    drops: int         # de-duplications of the plan with most of them


def programs(runnable: DataFrame, plan_actions: DataFrame) -> Programs:
    """What each plan of ``runnable(dataset_id, candidate_id)`` does; two numbers reach the driver."""
    steps = plan_actions.join(runnable.select(*PLAN_KEYS), PLAN_KEYS, "left_semi").groupBy(*PLAN_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("action_idx", "action", "columns"))).alias("steps"))
    none = F.array().cast("array<string>")
    fresh = F.struct(none.alias("trim"), none.alias("mark"))

    def add(done: Column, step: Column) -> Column:
        now = F.element_at(done, -1)
        kept = F.slice(done, F.lit(1), F.size(done) - 1)

        def wider(part: str, action: str) -> Column:
            return F.when(step["action"] == action, F.concat(now[part], step["columns"])).otherwise(now[part]).alias(part)
        return F.when(step["action"] == "REMOVE_EXACT_DUPLICATES", F.concat(done, F.array(fresh))).otherwise(
            F.concat(kept, F.array(F.struct(wider("trim", "TRIM_OUTER_WHITESPACE"),
                                            wider("mark", "STANDARDIZE_MISSING_MARKERS")))))
    folded = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<action_idx:int,action:string,columns:array<string>>>")),
                         F.array(fresh).cast(f"array<{_SEGMENT}>"), add)
    each = runnable.select(*PLAN_KEYS).join(steps, PLAN_KEYS, "left").select(*PLAN_KEYS, folded.alias("segments"))
    keeps = F.size("segments") == 1
    nth = F.row_number().over(Window.partitionBy("dataset_id", keeps).orderBy("candidate_id")) - 1
    plans = cut(each.withColumn("slot", F.when(keeps, nth)))
    most = plans.agg(F.max("slot"), F.max(F.size("segments"))).first()
    return Programs(plans, 0 if most[0] is None else most[0] + 1, (most[1] or 1) - 1)


def entry_cell(name: str) -> Column:
    """A source cell as the executor reads it: text, never null."""
    return F.coalesce(qcol(name), F.lit(""))


def _repaired(cell: Column, trimmed: Column, marked: Column) -> Column:
    missing = F.lower(T.strip(cell)).isin(*K.MISSING_MARKERS)
    return F.when(marked & missing, F.lit(None).cast("string")).otherwise(F.when(trimmed, T.strip(cell)).otherwise(cell))


def _segment_cells(columns: list[str], segment: Column) -> list[Column]:
    return [_repaired(qcol(c), F.array_contains(segment["trim"], c), F.array_contains(segment["mark"], c)).alias(c)
            for c in columns]


def dropped_rows(source: DataFrame, plans: DataFrame, drops: int, columns: list[str]) -> DataFrame:
    """``PLAN_KEYS, _row_id, columns`` of the plans with de-duplications (``segments`` of two or more)."""
    cells = [qcol(c) for c in columns]
    rows = (source.select("dataset_id", ROW_ID, *[entry_cell(c).alias(c) for c in columns])
            .join(plans.select(*PLAN_KEYS, "segments"), "dataset_id"))
    rows = rows.select(*PLAN_KEYS, ROW_ID, "segments", *_segment_cells(columns, F.col("segments")[0]))
    out = None
    for k in range(1, drops + 1):
        # First copy kept; a fixed-width buffer, so a hash aggregate with map-side combine.
        alike = rows.groupBy(*PLAN_KEYS, *cells).agg(F.min(ROW_ID).alias(ROW_ID))
        rows = (alike.join(plans.select(*PLAN_KEYS, "segments"), PLAN_KEYS)
                .select(*PLAN_KEYS, ROW_ID, "segments", *_segment_cells(columns, F.get("segments", F.lit(k)))))
        done = rows.filter(F.size("segments") == k + 1).select(*PLAN_KEYS, ROW_ID, *cells)
        out = done if out is None else out.unionByName(done)
        rows = rows.filter(F.size("segments") > k + 1)
    return out


def execute_candidates(source: DataFrame, runnable: DataFrame, plan_actions: DataFrame, columns: list[str]) -> DataFrame:
    """``PLAN_KEYS, _row_id, columns``: the output rows of every plan of ``runnable`` (a copy per plan; lazy)."""
    return _outputs(source, programs(runnable, plan_actions), columns)


def _outputs(source: DataFrame, p: Programs, columns: list[str]) -> DataFrame:
    keepers = p.plans.filter("slot is not null")
    rows = (source.select("dataset_id", ROW_ID, *[entry_cell(c).alias(c) for c in columns])
            .join(keepers.select(*PLAN_KEYS, "segments"), "dataset_id")
            .select(*PLAN_KEYS, ROW_ID, *_segment_cells(columns, F.col("segments")[0])))
    if p.drops == 0:
        return rows
    return rows.unionByName(dropped_rows(source, p.plans.filter("slot is null"), p.drops, columns))


# ------------------------------------------------------------------ row-keeping plans: variants of one row

def slot_table(p: Programs, columns: list[str]) -> DataFrame:
    """One row per dataset with a runnable plan: per slot the candidate and what it does to each column."""
    out: list[Column] = []
    for i in range(p.slots):
        here = F.col("slot") == i
        out.append(F.max(F.when(here, F.col("candidate_id"))).alias(f"cid{i}"))
        for k, c in enumerate(columns):
            for part in ("trim", "mark"):
                asked = F.array_contains(F.col("segments")[0][part], c)
                out.append(F.coalesce(F.max(F.when(here, asked)), F.lit(False)).alias(f"{part}{i}_{k}"))
    return cut(p.plans.groupBy("dataset_id").agg(F.count("*").alias("n_plans"), *out))


def _cell_facts(columns: list[str]) -> list[Column]:
    """What every variant needs of a cell, worked out once."""
    out: list[Column] = []
    for k, c in enumerate(columns):
        raw = entry_cell(c)
        v = T.strip(raw)
        limit = K.COORDINATE_LIMITS.get(T.normalize_name(c))
        valid = T.valid_coordinate(v, limit) if limit is not None else F.lit(False)
        some = v != ""
        out += [raw.alias(f"raw{k}"), v.alias(f"v{k}"), some.alias(f"some{k}"), raw.isin(*K.NA_TOKENS).alias(f"na{k}"),
                v.isin(*K.NA_TOKENS).alias(f"nav{k}"), F.lower(v).isin(*K.MISSING_MARKERS).alias(f"mk{k}"),
                (some & T.pii_match(v) & ~valid).alias(f"pii{k}"), (some & T.injection_match(v)).alias(f"told{k}"),
                (some & T.is_numeric(v)).alias(f"num{k}"), (some & ~valid).alias(f"off{k}")]
    return out


def _written(i: int, k: int) -> str:
    """SQL: the cell is not turned into a missing one by slot ``i``."""
    return f"not (mark{i}_{k} and mk{k})"


def _token(i: int, k: int) -> str:
    """SQL: the audit takes slot ``i``'s cell for a missing-value token."""
    return f"if(trim{i}_{k}, nav{k}, na{k})"


def _present(i: int, k: int) -> str:
    """SQL: the audit sees text in slot ``i``'s cell (then it is the stripped source text)."""
    return f"(some{k} and not {_token(i, k)} and {_written(i, k)})"


def _text(i: int, k: int) -> str:
    """SQL: the text of slot ``i``'s cell where it is written."""
    return f"if(trim{i}_{k}, v{k}, raw{k})"


def _encoded(cells: list[str]) -> str:
    """SQL of a row's hex SHA-256 over cells of which none is null."""
    return "sha2(concat_ws(',', " + ", ".join(f"concat(length({c}), ':', {c})" for c in cells) + "), 256)"


#: What a cell's kind is made of (names of :func:`_cell_facts`, a bit each).
KIND = ("some", "na", "nav", "mk", "pii", "told", "num", "off")


def variant_counts(facts: DataFrame, n_slots: int, n: int) -> DataFrame:
    """``dataset_id, part, kind, n, first, live, l0..``: what one pass over the rows counts.

    A row gives a record per column (parts from 0; how many cells are of each kind,
    and the first row with one), one for the source as read (part ``n``) and one per
    slot (``n + 1`` on), the last two with their summed limbs. The aggregate has the
    same few functions however many plans and columns there are: one with a function
    for each of them gives methods too long for the JVM to compile.
    """
    none = "cast(null as string)"
    records = []
    for k in range(n):
        kind = " + ".join(f"if({x}{k}, {1 << b}, 0)" for b, x in enumerate(KIND))
        records.append(f"struct({k} as part, {kind} as kind, {none} as _h, false as live)")
    records.append(f"struct({n} as part, 0 as kind, {_encoded([f'raw{k}' for k in range(n)])} as _h, false as live)")
    for i in range(n_slots):
        cells = [f"if({_written(i, k)}, {_text(i, k)}, '')" for k in range(n)]
        live = " or ".join(f"(some{k} and {_written(i, k)})" for k in range(n))
        records.append(f"struct({n + 1 + i} as part, 0 as kind, if(cid{i} is null, {none}, {_encoded(cells)}) as _h, ({live}) as live)")
    each = facts.selectExpr("dataset_id", "_o", f"inline(array({', '.join(records)}))")
    return each.selectExpr("dataset_id", "_o", "part", "kind", "live", *limb_words("_h")).groupBy("dataset_id", "part", "kind").agg(
        F.count("*").alias("n"), F.min("_o").alias("first"), F.count_if("live").alias("live"),
        *[F.expr(f"sum({x}) as l{j}") for j, x in enumerate(limbs("_h"))])


def variant_audits(source: DataFrame, slots: DataFrame, n_slots: int, columns: list[str],
                   type_sample_limit: int = K.TYPE_SAMPLE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Counts of every row-keeping plan (as ``audit.assemble`` takes them), and the source's fingerprint as read.

    ``slots`` is :func:`slot_table`; only datasets with a runnable plan are read.
    """
    n, all_slots = len(columns), range(n_slots)
    facts = source.select("dataset_id", F.col(ROW_ID).alias("_o"), *_cell_facts(columns)).join(slots, "dataset_id")
    counted = cut(variant_counts(facts, n_slots, n))
    sig = F.lit(signature(columns))
    fingerprint = fingerprint_of(sig, F.col("n"), [F.col(f"l{j}") for j in range(N_LIMBS)]).alias("fingerprint")
    seen = counted.filter(f"part = {n}").select("dataset_id", fingerprint)
    if n_slots == 0:
        return counted.limit(0), seen
    # From here on few rows: a dataset's kinds of cells, then its slots.
    bits = [f"(kind & {1 << b}) != 0 as {x}{k}" for b, x in enumerate(KIND) for k in range(n)]
    kinds = counted.filter(f"part < {n}").selectExpr("dataset_id", "part", "n", "first", *bits).join(slots, "dataset_id")
    aggs = []
    for i in all_slots:
        for k in range(n):
            here = f"part = {k} and {_present(i, k)}"
            counts = {"m": f"part = {k} and not {_present(i, k)}", "n": here, "c": f"{here} and off{k}", "p": f"{here} and pii{k}",
                      "j": f"{here} and told{k}"}
            aggs += [f"sum(if({x}, n, 0L)) as {name}{i}_{k}" for name, x in counts.items()]
            aggs += [f"min(if({here} and num{k}, first, null)) as fn{i}_{k}",
                     f"min(if({here} and not num{k}, first, null)) as ft{i}_{k}"]
    per_slot = [F.struct(F.expr(f"cid{i} as candidate_id"), F.lit(i).alias("slot"),
                         *[F.expr(f"{x}{i}_{k} as {x}{k}") for x in ("m", "n", "c", "p", "j", "fn", "ft") for k in range(n)])
                for i in all_slots]
    ids = slots.select("dataset_id", *[f"cid{i}" for i in all_slots])
    of_cells = (kinds.groupBy("dataset_id").agg(*[F.expr(a) for a in aggs]).join(ids, "dataset_id")
                .select("dataset_id", F.inline(F.array(*per_slot))).filter("candidate_id is not null"))
    of_rows = counted.filter(f"part > {n}").select("dataset_id", (F.col("part") - (n + 1)).alias("slot"),
                                                   F.col("n").alias("row_count"), "live", fingerprint)
    wide = cut(of_cells.join(of_rows, ["dataset_id", "slot"]))

    # The rows as the audit sees them: missing cells and tokens are "~".
    def folded(i: int, k: int) -> str:
        return (f"if({_written(i, k)} and not {_token(i, k)}, concat(length({_text(i, k)}), ':', {_text(i, k)}), '~')")
    rows = ", ".join(f"struct(cid{i} as candidate_id, unhex(sha2(concat_ws(',', "
                     + ", ".join(folded(i, k) for k in range(n)) + "), 256)) as _d)" for i in all_slots)
    digests = facts.selectExpr("dataset_id", f"inline(array({rows}))").filter("candidate_id is not null")
    copies = (digests.groupBy(*PLAN_KEYS, "_d").agg(F.count("*").alias("_n")).groupBy(*PLAN_KEYS)
              .agg((F.sum("_n") - F.count("*")).alias("duplicate_row_count")))
    ranks = _variant_ranks(facts, wide, n_slots, n, type_sample_limit)
    return wide.join(ranks, PLAN_KEYS, "left").join(copies, PLAN_KEYS, "left"), seen


def _variant_ranks(facts: DataFrame, wide: DataFrame, n_slots: int, n: int, limit: int) -> DataFrame:
    """Rank of the type-sample cut per variant; the source is read again only where a column needs it."""
    late = wide.selectExpr("dataset_id", "candidate_id", "slot", *[
        f"if(fn{k} is not null and ft{k} is not null and n{k} > {limit}, greatest(fn{k}, ft{k}), null) as t{k}" for k in range(n)])
    asked = late.filter("coalesce(" + ", ".join(f"t{k}" for k in range(n)) + ") is not null")
    if not asked.take(1):
        return late.selectExpr(*PLAN_KEYS, *[f"cast(null as bigint) as r{k}" for k in range(n)])
    every = [(i, k) for i in range(n_slots) for k in range(n)]
    cuts = asked.groupBy("dataset_id").agg(*[F.expr(f"max(if(slot = {i}, t{k}, null)) as t{i}_{k}") for i, k in every])
    ends = ", ".join(f"t{i}_{k}" for i, k in every)
    last = ends if len(every) == 1 else f"greatest({ends})"
    ranks = facts.join(cuts, "dataset_id").filter(f"_o <= {last}").groupBy("dataset_id").agg(*[
        F.expr(f"count_if(_o <= t{i}_{k} and {_present(i, k)}) as r{i}_{k}") for i, k in every])
    each = ", ".join(f"struct({i} as slot, " + ", ".join(f"r{i}_{k} as r{k}" for k in range(n)) + ")" for i in range(n_slots))
    return ranks.selectExpr("dataset_id", f"inline(array({each}))").join(
        late.select(*PLAN_KEYS, "slot"), ["dataset_id", "slot"]).drop("slot")


def source_fingerprints(source: DataFrame, columns: list[str]) -> DataFrame:
    """``dataset_id, fingerprint`` (S9) as of now: one combined aggregate, no digest shuffled."""
    cells = source.select("dataset_id", *[entry_cell(c).alias(f"c{k}") for k, c in enumerate(columns)])
    hashed = cells.selectExpr("dataset_id", _encoded([f"c{k}" for k in range(len(columns))]) + " as _h")
    summed = hashed.selectExpr("dataset_id", *limb_words("_h")).groupBy("dataset_id").agg(F.count("*").alias("n"), *[
        F.expr(f"sum({x}) as l{j}") for j, x in enumerate(limbs("_h"))])
    return summed.select("dataset_id", fingerprint_of(F.lit(signature(columns)), F.col("n"), [F.col(f"l{j}") for j in range(N_LIMBS)])
                         .alias("fingerprint"))


def output_fingerprints(source: DataFrame, runnable: DataFrame, plan_actions: DataFrame, columns: list[str]) -> DataFrame:
    """``PLAN_KEYS, fingerprint``: outputs worked out again from the source, for lineage and export."""
    out = execute_candidates(source, runnable, plan_actions, columns)
    one = F.struct(*PLAN_KEYS)
    return source_fingerprints(out.withColumn("dataset_id", one), columns).select("dataset_id.*", "fingerprint")


# ------------------------------------------------------------------ trials

def _either(a: AuditResult | None, b: AuditResult | None) -> AuditResult:
    if a is None or b is None:
        return a or b
    return AuditResult(findings=a.findings.unionByName(b.findings), audits=a.audits.unionByName(b.audits))


def run_trials(source: DataFrame, columns: list[str], before: AuditResult, plans: DataFrame,
               plan_actions: DataFrame, policies: DataFrame, reviews: DataFrame | None = None,
               recheck: bool = True) -> TrialResult:
    """Authorize, execute and re-audit every candidate; see the module text.

    ``recheck`` reads the source once more after the outputs, so that a change
    while the trials ran is seen too.
    """
    plan_decisions, action_decisions = authorize(before.audits, before.findings, plans,
                                                 plan_actions, policies)
    plan_decisions, action_decisions = cut(plan_decisions), cut(action_decisions)
    audited = before.audits.select("dataset_id", "fingerprint")
    status = cut(trial_status(plan_decisions, action_decisions, plans, plan_actions, columns, audited)
                 .join(plan_hashes(plans, plan_actions), PLAN_KEYS, "left"))
    p = programs(status.filter("status = 'RUN'"), plan_actions)
    slots = slot_table(p, columns)
    wide, seen = variant_audits(source, slots, p.slots, columns)
    kept = dropped = None
    outputs = lambda: _outputs(source, p, columns)
    if p.slots:
        kept = assemble(wide, PLAN_KEYS, columns, reviews=reviews, materialize=True)
    if p.drops:
        rows = cut(dropped_rows(source, p.plans.filter("slot is null"), p.drops, columns))
        dropped = audit(rows, keys=PLAN_KEYS, columns=columns, order_col=ROW_ID, reviews=reviews, materialize=True)
        keepers = Programs(p.plans.filter("slot is not null"), p.slots, 0)
        outputs = lambda: _outputs(source, keepers, columns).unionByName(rows)
    after = _either(kept, dropped)
    if after is None:  # nothing may run
        after = assemble(audit_counts_of_none(source, columns), PLAN_KEYS, columns)
    if recheck:
        seen = seen.unionByName(source_fingerprints(source.join(slots.select("dataset_id"), "dataset_id", "left_semi"), columns))
    changed = seen.join(audited.withColumnRenamed("fingerprint", "then"), "dataset_id").groupBy("dataset_id").agg(
        F.bool_or(~F.col("fingerprint").eqNullSafe(F.col("then"))).alias("changed"))
    ran = F.col("status") == "RUN"
    result = (F.when(F.coalesce("changed", F.lit(False)), "SOURCE_CHANGED").when(~ran, F.col("status"))
              .when(F.col("_after").isNull(), "TRIAL_FAILED").when(F.col("_after") == "BLOCKED", "OUTPUT_BLOCKED")
              .otherwise("REAUDITED"))
    trials = (status.join(after.audits.select(*PLAN_KEYS, F.col("status").alias("_after"), "fingerprint"), PLAN_KEYS, "left")
              .join(changed, "dataset_id", "left")
              .select(*PLAN_KEYS, result.alias("status"),
                      F.when(ran & F.col("_after").isNull(), "NO_OUTPUT").otherwise(F.col("error")).alias("error"),
                      F.when(result.isin("REAUDITED", "OUTPUT_BLOCKED"), F.col("fingerprint")).alias("output_fingerprint"),
                      "plan_hash"))
    return TrialResult(plan_decisions, action_decisions, cut(trials), after, outputs)


def audit_counts_of_none(source: DataFrame, columns: list[str]) -> DataFrame:
    """The empty table of counts (no candidate ran)."""
    counts = [f"{x}{k} bigint" for x in ("m", "n", "c", "p", "j", "r") for k in range(len(columns))]
    firsts = [f"{x}{k} bigint" for x in ("fn", "ft") for k in range(len(columns))]
    return source.sparkSession.createDataFrame([], ", ".join(
        ["dataset_id string", "candidate_id string", "live bigint", "row_count bigint", "duplicate_row_count bigint",
         "fingerprint string", *counts, *firsts]))
