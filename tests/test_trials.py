"""T-1 execution of many candidates of many datasets, checked against a brute-force
per-candidate replay in plain Python, plus the shape of the physical plan."""
import random

import pytest
from pyspark.sql import functions as F

from vettable.functions import constants as K
from vettable.operators.trials import execute_candidates
from vettable.plans.governed import candidate_batch

COLS = ["a", "b"]
CANDIDATES = {
    "dedupe": [("REMOVE_EXACT_DUPLICATES", [])],
    "markers_then_dedupe": [("STANDARDIZE_MISSING_MARKERS", ["a"]), ("REMOVE_EXACT_DUPLICATES", [])],
    "dedupe_then_trim": [("REMOVE_EXACT_DUPLICATES", []), ("TRIM_OUTER_WHITESPACE", ["a", "b"])],
    "trim_markers": [("TRIM_OUTER_WHITESPACE", ["b"]), ("STANDARDIZE_MISSING_MARKERS", ["b"])],
}
VALUES = ["x", " x", "x ", "NA", " n/a ", "", None, "null", "y", "None"]


def _rows(seed):
    rnd = random.Random(seed)
    out = []
    for ds in ("d1", "d2", "d3"):
        for i in range(60):
            out.append((ds, i, rnd.choice(VALUES), rnd.choice(VALUES)))
    return out


def _strip(v):
    return None if v is None else v.strip(K.STRIP_CHARS)


def _replay(rows, plan):
    """Brute force: apply the actions in order to a list of (row_id, a, b)."""
    cur = [(rid, a or "", b or "") for _, rid, a, b in rows]
    for action, cols in plan:
        if action == "REMOVE_EXACT_DUPLICATES":
            first = {}
            for rid, a, b in sorted(cur):
                first.setdefault((a, b), (rid, a, b))
            cur = list(first.values())
        else:
            nxt = []
            for rid, a, b in cur:
                vals = {"a": a, "b": b}
                for c in cols:
                    v = vals[c]
                    if action == "TRIM_OUTER_WHITESPACE":
                        vals[c] = _strip(v)
                    elif v is not None and v.strip(K.STRIP_CHARS).lower() in K.MISSING_MARKERS:
                        vals[c] = None
                nxt.append((rid, vals["a"], vals["b"]))
            cur = nxt
    return sorted(cur, key=lambda r: r[0])


def _setup(spark):
    rows = _rows(7)
    src = spark.createDataFrame(rows, "dataset_id string, _row_id bigint, a string, b string")
    audits = src.select("dataset_id").distinct().select(
        "dataset_id", F.lit("0" * 64).alias("fingerprint"))
    plans, acts = candidate_batch(spark, audits, CANDIDATES)
    runnable = plans.select("dataset_id", "candidate_id")
    return rows, src, runnable, acts


def test_every_candidate_matches_brute_force(spark):
    rows, src, runnable, acts = _setup(spark)
    out = execute_candidates(src, runnable, acts, COLS).collect()
    got = {}
    for r in out:
        got.setdefault((r["dataset_id"], r["candidate_id"]), []).append((r["_row_id"], r["a"], r["b"]))
    for ds in ("d1", "d2", "d3"):
        part = [r for r in rows if r[0] == ds]
        for cid, plan in CANDIDATES.items():
            assert sorted(got[(ds, cid)], key=lambda r: r[0]) == _replay(part, plan), (ds, cid)


def test_copies_are_never_partitioned_by_candidate(spark):
    _, src, runnable, acts = _setup(spark)
    plan = execute_candidates(src, runnable, acts, COLS)._jdf.queryExecution() \
        .executedPlan().toString()
    # The plans join the source once, as a broadcast; no sort-merge join
    # re-partitions the copies by candidate, and dedupe is a hash aggregate.
    assert "SortMergeJoin" not in plan
    assert "Broadcast" in plan
    assert "SortAggregate" not in plan


def _analysis(spark, candidates, src=None, trial_src=None):
    from vettable.operators import trials as TR
    from vettable.operators.audit import audit
    from vettable.plans.governed import safe_policy

    if src is None:
        _, src, _, _ = _setup(spark)
    before = audit(src, columns=COLS, order_col="_row_id", materialize=True)
    plans, acts = candidate_batch(spark, before.audits, candidates)
    t = TR.run_trials(trial_src or src, COLS, before, plans, acts, safe_policy(before.audits))
    return t, src, plans, acts


@pytest.mark.parametrize("sample", [2000, 7])
def test_variants_of_one_scan_audit_like_copies(spark, monkeypatch, sample):
    """Counts from the one scan equal an audit of the written-out copies, also where the type sample is late."""
    from vettable.operators import trials as TR
    from vettable.operators.audit import audit

    more = dict(CANDIDATES, none=[], twice=[("REMOVE_EXACT_DUPLICATES", []), ("TRIM_OUTER_WHITESPACE", ["a"]),
                                            ("REMOVE_EXACT_DUPLICATES", [])], markers=[("STANDARDIZE_MISSING_MARKERS", ["a", "b"])])
    rnd = random.Random(3)
    rows = [(ds, i, rnd.choice(VALUES + ["7", " 8", "a@b.cd", "555-123-4567"]), rnd.choice(VALUES + ["1.5", "system prompt"]))
            for ds in ("d1", "d2") for i in range(80)]
    src = spark.createDataFrame(rows, "dataset_id string, _row_id bigint, a string, b string")
    audits = src.select("dataset_id").distinct().select("dataset_id", F.lit("0" * 64).alias("fingerprint"))
    plans, acts = candidate_batch(spark, audits, more)
    p = TR.programs(plans, acts)
    assert (p.slots, p.drops) == (3, 2)
    wide, seen = TR.variant_audits(src, TR.slot_table(p, COLS), p.slots, COLS, type_sample_limit=sample)
    got = TR.assemble(wide, TR.PLAN_KEYS, COLS, type_sample_limit=sample)
    copies = TR.execute_candidates(src, plans, acts, COLS).filter(F.col("candidate_id").isin("none", "trim_markers", "markers"))
    want = audit(copies, keys=TR.PLAN_KEYS, columns=COLS, order_col="_row_id", type_sample_limit=sample)
    assert sorted(map(tuple, got.audits.collect())) == sorted(map(tuple, want.audits.collect()))
    assert sorted(map(str, got.findings.collect())) == sorted(map(str, want.findings.collect()))
    now = audit(src, columns=COLS, order_col="_row_id").audits.select("dataset_id", "fingerprint")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, now.collect()))
    again = TR.output_fingerprints(src, plans, acts, COLS)
    assert {tuple(r) for r in want.audits.select(*TR.PLAN_KEYS, "fingerprint").collect()} <= {tuple(r) for r in again.collect()}


def test_a_failing_candidate_stops_no_other(spark):
    t, *_ = _analysis(spark, {"good": CANDIDATES["dedupe"], "column": [("TRIM_OUTER_WHITESPACE", ["c"])],
                              "rows": [("REMOVE_EXACT_DUPLICATES", ["a"])], "empty": [("STANDARDIZE_MISSING_MARKERS", [])]})
    got = {r.candidate_id: (r.status, r.error, r.output_fingerprint is not None) for r in t.trials.filter("dataset_id = 'd1'").collect()}
    assert got == {"good": ("REAUDITED", None, True), "column": ("TRIAL_FAILED", "UNKNOWN_COLUMN", False),
                   "rows": ("TRIAL_FAILED", "ROWS_TAKE_NO_COLUMNS", False), "empty": ("TRIAL_FAILED", "COLUMNS_REQUIRED", False)}


def test_a_changed_source_invalidates_its_dataset_only(spark):
    _, src, _, _ = _setup(spark)
    other = src.withColumn("a", F.when((F.col("dataset_id") == "d2") & (F.col("_row_id") == 3), "changed").otherwise(F.col("a")))
    t, *_ = _analysis(spark, CANDIDATES, src, other)
    got = {}
    for r in t.trials.collect():
        got.setdefault(r.dataset_id, set()).add((r.status, r.output_fingerprint is None))
    assert got == {"d1": {("REAUDITED", False)}, "d2": {("SOURCE_CHANGED", True)}, "d3": {("REAUDITED", False)}}


def test_batch_rules_hold_before_any_trial(spark):
    t, *_ = _analysis(spark, {"one": CANDIDATES["dedupe"], "two": CANDIDATES["dedupe"]})
    assert {(r.status, r.error) for r in t.trials.collect()} == {("BATCH_INVALID", "DUPLICATE_STRATEGY")}
    assert t.after.audits.count() == 0 and t.outputs.count() == 0


def test_gate_refuses_an_action_that_is_not_approved_by_itself(spark):
    from vettable.operators.policy import execution_gate
    plans = spark.createDataFrame([("d", "p", "f" * 64)], "dataset_id string, candidate_id string, source_fingerprint string")
    acts = spark.createDataFrame([("d", "p", 0, "TRIM_OUTER_WHITESPACE", ["a"])],
                                 "dataset_id string, candidate_id string, action_idx int, action string, columns array<string>")
    decided = plans.withColumn("status", F.lit("APPROVED")).withColumn("can_execute", F.lit(True))
    now = plans.select("dataset_id", F.col("source_fingerprint").alias("fingerprint"))
    for decision, checks in (("APPROVED", []), ("REQUIRES_REVIEW", ["ACTION_NOT_APPROVED"])):
        r = execution_gate(plans, acts, decided, acts.withColumn("decision", F.lit(decision)), now).collect()[0]
        assert (r.ready, r.failed_checks) == (not checks, checks)


def test_every_terminal_state_of_a_governed_fleet(spark):
    import __spark_entry__ as E
    rows = {r.dataset_id: r for r in E.queries()["governed_run"](spark, "/root/testdata/sf0.001").collect()}
    assert {n: r.outcome for n, r in rows.items()} == {
        "clean": "READY", "marked": "REPAIRED", "contacts": "REQUIRES_REVIEW", "blank": "BLOCKED", "stale": "DENIED",
        "emptied": "EXECUTION_FAILED", "unsupported": "EXECUTION_FAILED", "misnamed": "EXECUTION_FAILED", "unplanned": "NO_PLAN"}
    assert {n: r.reason for n, r in rows.items() if r.reason} == {
        "emptied": "OUTPUT_BLOCKED", "unsupported": "UNSUPPORTED", "misnamed": "UNKNOWN_COLUMN"}
    assert rows["marked"].output_fingerprint and rows["marked"].source_preserved


def test_unbroadcast_plan_join_gives_the_same_outputs(spark):
    """Beyond Spark's broadcast threshold the plans join by a shuffle on dataset_id."""
    from vettable.operators import trials as TR

    rows, src, runnable, acts = _setup(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = TR.execute_candidates(src, runnable, acts, COLS).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {}
    for r in out:
        got.setdefault((r["dataset_id"], r["candidate_id"]), []).append((r["_row_id"], r["a"], r["b"]))
    for ds in ("d1", "d2", "d3"):
        part = [r for r in rows if r[0] == ds]
        for cid, plan in CANDIDATES.items():
            assert sorted(got[(ds, cid)], key=lambda r: r[0]) == _replay(part, plan), (ds, cid)


def test_the_pass_over_the_rows_has_as_few_functions_for_many_plans(spark):
    """One function per plan and column made methods too long for the JVM to compile."""
    from vettable.operators import trials as TR
    columns = [f"c{k}" for k in range(8)]
    src = spark.createDataFrame([("d", 1, *["x"] * 8), ("d", 2, *["NA"] * 8)],
                                "dataset_id string, _row_id long, " + ", ".join(f"{c} string" for c in columns))
    batch = {f"p{i}": [("STANDARDIZE_MISSING_MARKERS", [columns[i]])] for i in range(4)}
    _, acts = candidate_batch(spark, spark.createDataFrame([("d", "f")], "dataset_id string, fingerprint string"), batch)
    p = TR.programs(acts.select("dataset_id", "candidate_id").distinct(), acts)
    facts = src.select("dataset_id", F.col("_row_id").alias("_o"), *TR._cell_facts(columns)).join(TR.slot_table(p, columns), "dataset_id")
    counted = TR.variant_counts(facts, p.slots, len(columns))
    assert len(counted.columns) == 6 + TR.N_LIMBS
    rows = counted.collect()
    assert {r.part: sum(x.n for x in rows if x.part == r.part) for r in rows} == {part: 2 for part in range(8 + 1 + 4)}
    assert sorted((r.n, r.first) for r in rows if r.part == 0) == [(1, 1), (1, 2)]
