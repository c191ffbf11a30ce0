"""Contracts as data: each rule turns offending rows into (rule, key) rows.

`check` evaluates row rules in one pass over the table; set rules (unique, references,
same sets, acyclic) are queries of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed and required fields of trace events.
TRACE_FIELDS = {
    "span": ("stage page_id model operation_count duration_ms", "stage duration_ms"),
    "worker": ("stage page_id model operation_count duration_ms status", "duration_ms status"),
    "local_agent": ("image_count total_bytes duration_ms status", "image_count total_bytes duration_ms status"),
    "worker_start": ("stage page_id model operation_count", "stage"),
    "worker_finish": ("stage page_id model operation_count duration_ms status", "stage duration_ms status"),
    "model_load_start": ("page_id model", "model"),
    "model_load_finish": ("page_id model duration_ms status", "model duration_ms status"),
    "inference_start": ("stage page_id model operation_count", "stage"),
    "inference_finish": ("stage page_id model operation_count duration_ms status", "stage duration_ms status"),
    "agent_request_published": ("page_id operation_count", "page_id"),
    "agent_plan_recorded": ("page_id operation_count duration_ms status", "page_id duration_ms status"),
    "device_summary": ("platform device cuda_available mps_available", "platform device cuda_available mps_available"),
}
KINDS, STATES = ("parent", "child", "text"), ("pending", "pending_gate", "failed", "frozen", "inactive")
PHASES = (
    "request_published awaiting_plan plan_recorded actions_executed quality_recorded freeze_committed fallback_required fallback_executed fallback_quality_recorded ready_for_assembly preserved_with_warning"
).split()
VERB_ARITY = {
    "accept": (1, 1), "discard": (1, 1), "split": (1, 1), "expand": (1, 1), "shrink": (1, 1), "retry": (1, 1), "retry_with_box": (1, 1), "retry_with_points": (1, 1), "suppress_text": (1, 1),
    "collapse_to_parent": (1, 1), "absorb_residual": (1, 1), "rebuild_background": (1, 99), "merge": (2, 99), "attach_text": (2, 99), "absorb_into_parent": (2, 99),
}
SHA = r"^[0-9a-f]{64}$"


def check(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """rule, then key columns, for each row that breaks a rule (a null test breaks it too)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), *key)


def unique(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), *columns)


def dangling(df: DataFrame, rule: str, column: str, other: DataFrame, to: str, *keys: str) -> DataFrame:
    """Rows whose reference has no target of the same keys."""
    known = other.select(*keys, F.col(to).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(known, [*keys, column], "left_anti").select(F.lit(rule).alias("rule"), *keys, column)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def node_rules() -> dict[str, Column]:
    c = F.col
    return {"kind": c("kind").isin(*KINDS), "state": c("state").isin(*STATES), "box": (c("x") >= 0) & (c("y") >= 0) & (c("w") > 0) & (c("h") > 0), "z": c("z").isNotNull()}


def graph_violations(nodes: DataFrame) -> DataFrame:
    """rule, page, node: what breaks a component graph.

    Unique ids, unique z among active nodes, parents that exist, no cycle, and no active
    child below an active parent.
    """
    from docloom.operators.graph import on_cycles

    key = ["page", "node"]
    rows = check(nodes, key, node_rules())
    ids = unique(nodes, "unique_id", "page", "node")
    active = nodes.filter("state <> 'inactive'")
    z = active.groupBy("page", "z").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n > 1").select(F.lit("unique_z").alias("rule"), "page", "node")
    lost = dangling(nodes, "parent_exists", "parent", nodes, "node", "page").select("rule", "page", F.col("parent").alias("node"))
    loops = on_cycles(nodes).select(F.lit("acyclic").alias("rule"), "page", "node")
    up = active.select("page", F.col("node").alias("parent"), F.col("kind").alias("pk"))
    both = active.filter("kind <> 'text'").join(up.filter("pk <> 'text'"), ["page", "parent"]).select(F.lit("active_family").alias("rule"), "page", "node")
    return _all(rows, ids, z, lost, loops, both)


def transition_violations(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """rule, page, node: frozen rows that changed or went without leave, ids that were lost.

    before, after: page, node, state, record; allowed: page, node.
    """
    b = before.select("page", "node", F.col("state").alias("s"), F.col("record").alias("r"))
    a = after.select("page", "node", F.col("state").alias("s2"), F.col("record").alias("r2"))
    both = b.join(a, ["page", "node"], "full_outer").join(allowed.select("page", "node").distinct().withColumn("_ok", F.lit(True)), ["page", "node"], "left")
    frozen = (F.col("s") == "frozen") & F.col("_ok").isNull()
    rule = F.when(F.col("s2").isNull(), "lost").when(frozen & ~F.col("r").eqNullSafe(F.col("r2")), "frozen_changed").when(frozen & (F.col("s2") != "frozen"), "frozen_opened")
    return both.select(rule.alias("rule"), "page", "node").filter("rule is not null")


def plan_violations(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """rule, page, node for actions (page, node, verb, score, cited array<long>).

    Verbs and their number of objects, confidence in [0, 1], one action an object, known
    targets, no change of frozen or inactive nodes but accepting and retrying.
    """
    n = F.size("cited")
    arity = F.lit(False)
    for verb, (low, high) in VERB_ARITY.items():
        arity = F.when(F.col("verb") == verb, n.between(1 if low == 1 else low, max(high, 2))).otherwise(arity)
    rules = {"verb": F.col("verb").isin(*VERB_ARITY), "arity": arity, "confidence": F.col("score").between(0, 1)}
    rows = check(actions, ["page", "node"], rules)
    twice = unique(actions, "one_action", "page", "node")
    lost = dangling(actions.select("page", "node"), "known_target", "node", nodes, "node", "page")
    state = nodes.select("page", "node", "state", "kind")
    role = actions.join(state, ["page", "node"])
    wrong = (F.col("state").isin("frozen", "inactive") & ~F.col("verb").isin("accept", "retry", "retry_with_box", "retry_with_points")) | ((F.col("verb") == "suppress_text") != (F.col("kind") == "text"))
    roles = role.filter(wrong).select(F.lit("role").alias("rule"), "page", "node")
    return _all(rows, twice, lost, roles)


def ir_violations(objects: DataFrame, width: int, height: int) -> DataFrame:
    """rule, page, node: boxes outside the canvas, repeated ids, native shapes without raster.

    objects: page, node, x, y, w, h, candidates array<string>.
    """
    c = F.col
    rules = {
        "box": (c("x") >= 0) & (c("y") >= 0) & (c("w") > 0) & (c("h") > 0) & (c("x") + c("w") <= width) & (c("y") + c("h") <= height),
        "native_needs_raster": ~F.array_contains("candidates", "native_shape") | F.array_contains("candidates", "raster"),
        "has_candidate": F.size("candidates") > 0,
    }
    return _all(check(objects, ["page", "node"], rules), unique(objects, "unique_id", "page", "node"))


def coverage_violations(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """rule, page, node: a plan must hold exactly the ids of the document."""
    a, b = plan.select("page", "node"), objects.select("page", "node")
    return a.exceptAll(b).select(F.lit("unknown").alias("rule"), "page", "node").unionAll(b.exceptAll(a).select(F.lit("missing").alias("rule"), "page", "node"))


def route_rules() -> dict[str, Column]:
    return {"route": F.col("route").isin("editable_text", "native_shape", "raster"), "confidence": F.col("score").between(0, 1)}


def request_violations(requests: DataFrame) -> DataFrame:
    """rule, page for requests (page, round, open, frozen: id arrays, evidence array<string>)."""
    sorted_ids = lambda c: F.col(c).eqNullSafe(F.array_sort(F.array_distinct(c)))
    rules = {"open_sorted": sorted_ids("open"), "frozen_sorted": sorted_ids("frozen"), "disjoint": ~F.arrays_overlap("open", "frozen"), "round": F.col("round").between(1, 5), "evidence": F.size("evidence") > 0}
    return check(requests, ["page"], rules)


def repair_state_violations(states: DataFrame) -> DataFrame:
    """rule, page for states (page, phase, round, revision, plan_ref, qa_ref, fallback_reason)."""
    c = F.col
    planned = c("phase").isin("plan_recorded", "actions_executed", "quality_recorded", "freeze_committed")
    measured = c("phase").isin("quality_recorded", "freeze_committed")
    rules = {
        "phase": c("phase").isin(*PHASES), "round": c("round").between(0, 5), "revision": c("revision") >= 0, "plan_ref": ~planned | c("plan_ref").isNotNull(),
        "qa_ref": ~measured | c("qa_ref").isNotNull(), "fallback": (c("phase") == "preserved_with_warning") == c("fallback_reason").isNotNull(),
    }
    return check(states, ["page"], rules)


def report_violations(stored: DataFrame, computed: DataFrame, *columns: str) -> DataFrame:
    """rule, page, node where a stored report differs from its recomputation."""
    a = stored.select("page", "node", F.struct(*columns).alias("a"))
    b = computed.select("page", "node", F.struct(*columns).alias("b"))
    return a.join(b, ["page", "node"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit("report").alias("rule"), "page", "node")


def inventory_violations(objects: DataFrame, candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """rule, page: candidates are the objects marked so, and totals agree.

    objects: page, object, action; candidates: page, object; totals: page, objects, candidates.
    """
    marked = objects.filter("action = 'candidate'").select("page", "object")
    diff = marked.exceptAll(candidates.select("page", "object")).unionAll(candidates.select("page", "object").exceptAll(marked)).select(F.lit("candidates").alias("rule"), "page").distinct()
    n = objects.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "candidate").alias("c"))
    wrong = totals.join(n, "page", "full_outer").filter(~(F.col("objects").eqNullSafe(F.col("n")) & F.col("candidates").eqNullSafe(F.col("c")))).select(F.lit("totals").alias("rule"), "page")
    return diff.unionAll(wrong)


def patch_violations(before: DataFrame, after: DataFrame, replaced: DataFrame) -> DataFrame:
    """rule, page: what a replaced slide must leave alone (page, object, sha each).

    Objects but the replaced ones keep their hashes as a multiset, and those are gone.
    """
    kept = before.join(replaced.select("page", "object"), ["page", "object"], "left_anti").select("page", "sha")
    lost = kept.exceptAll(after.select("page", "sha")).select(F.lit("protected_lost").alias("rule"), "page").distinct()
    still = after.join(replaced.select("page", "object"), ["page", "object"], "left_semi").select(F.lit("target_kept").alias("rule"), "page").distinct()
    return lost.unionAll(still)


def reference_blocks(objects: DataFrame) -> DataFrame:
    """Pages in which a connector or timing reference points at the shape to be replaced."""
    return objects.filter((F.col("type") == "connector") & F.col("refers_to_target") | F.col("has_timing_reference")).select("page").distinct()


def trace_event_violations(events: DataFrame, key: list[str]) -> DataFrame:
    """rule, key: unknown events, fields that an event may not or must have, bad values."""
    fields = ("stage", "page_id", "model", "operation_count", "duration_ms", "status", "image_count", "total_bytes")
    have = [f for f in fields if f in events.columns]
    known = F.col("event").isin(*TRACE_FIELDS)
    allowed = required = F.lit(True)
    for f in have:
        may = [e for e, (a, _) in TRACE_FIELDS.items() if f in a.split()]
        must = [e for e, (_, r) in TRACE_FIELDS.items() if f in r.split()]
        allowed = allowed & (F.col(f).isNull() | ~known | F.col("event").isin(*may))
        required = required & (F.col(f).isNotNull() | ~F.col("event").isin(*must))
    rules = {"known_event": known, "allowed_fields": allowed, "required_fields": required}
    form = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
    for f in have:
        if f in ("stage", "page_id", "model"):
            rules[f"{f}_form"] = F.col(f).isNull() | F.col(f).cast("string").rlike(form)
        elif f == "status":
            rules["status_value"] = F.col(f).isNull() | F.col(f).isin("success", "error")
        else:
            rules[f"{f}_range"] = F.col(f).isNull() | (F.col(f) >= 0)
    return check(events, key, rules)


def summary_violations(flat: DataFrame, most: int = 10**12) -> DataFrame:
    """rule, page, field, key of a trace roll-up with values out of range."""
    return check(flat, ["page", "field", "key"], {"range": F.col("value").between(0, most), "field": F.length("field") > 0})


def diagnostics_violations(rows: DataFrame, width: int, height: int, most: int = 96) -> DataFrame:
    """rule, page, ord: boxes in the page, unique keys, at most `most` rows a page."""
    c = F.col
    inside = (c("x") >= 0) & (c("y") >= 0) & (c("w") > 0) & (c("h") > 0) & (c("x") + c("w") <= width) & (c("y") + c("h") <= height)
    many = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("ord")).filter(F.col("n") > most).select(F.lit("too_many").alias("rule"), "page", "ord")
    return _all(check(rows, ["page", "ord"], {"box": inside}), unique(rows, "unique_key", "page", "ord"), many)
