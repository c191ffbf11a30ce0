"""Run, page and repair state: legal edges, resets and id-set updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The legal edges of runs and pages.
RUN_EDGES = {
    "created": ("prepared", "failed", "cancelled"),
    "prepared": ("running", "failed", "cancelled"),
    "running": ("awaiting_agent", "finalizing", "failed", "cancelled"),
    "awaiting_agent": ("prepared",),
    "finalizing": ("completed", "failed"),
    "failed": ("prepared",),
    "completed": (),
    "cancelled": (),
}
PAGE_EDGES = {
    "pending": ("analyzed", "processing", "failed"),
    "analyzed": ("preserved", "processing", "failed"),
    "processing": ("awaiting_agent", "validated", "preserved_with_warning", "failed"),
    "awaiting_agent": ("processing",),
    "validated": ("replaced", "preserved_with_warning", "failed"),
    "failed": ("pending",),
    "preserved": (),
    "replaced": (),
    "preserved_with_warning": (),
}
MOST_ROUNDS = 5


def edges(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, targets in table.items() for b in targets], "state string, target string")


def legal(state: Column, target: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether an edge is in the table; unknown states have none."""
    pairs = [f"{a}>{b}" for a, targets in table.items() for b in targets]
    return F.coalesce(F.concat(state, F.lit(">"), target).isin(*pairs), F.lit(False))


def illegal_steps(log: DataFrame, table: dict[str, tuple[str, ...]], column: str = "state") -> DataFrame:
    """page, seq, state, target of steps that no edge allows; staying isn't a step.

    log: page, seq and the state column.
    """
    w = Window.partitionBy("page").orderBy("seq")
    steps = log.select("page", "seq", F.lag(column).over(w).alias("state"), F.col(column).alias("target")).filter("state is not null and state <> target")
    return steps.filter(~legal(F.col("state"), F.col("target"), table))


def transition(documents: DataFrame, targets: DataFrame, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """page, state, applied: the target where the edge is legal, else the old state."""
    both = documents.join(targets.select("page", "target"), "page", "left")
    ok = F.col("target").isNotNull() & legal(F.col("state"), F.col("target"), table)
    return both.select("page", F.when(ok, F.col("target")).otherwise(F.col("state")).alias("state"), ok.alias("applied"))


def replay(log: DataFrame, table: dict[str, tuple[str, ...]], start: str) -> DataFrame:
    """page, state, applied, rejected after a log's targets, illegal ones being skipped.

    An ordered fold of each page's history, in generated code.
    """
    flat = [f"{a}>{b}" for a, targets in table.items() for b in targets]
    known = F.array(*[F.lit(x) for x in flat])
    history = F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda s: s["state"])
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))

    def step(acc, target):
        ok = F.array_contains(known, F.concat(acc["state"], F.lit(">"), target))
        return F.struct(F.when(ok, target).otherwise(acc["state"]).alias("state"), (acc["applied"] + ok.cast("int")).alias("applied"), (acc["rejected"] + (~ok).cast("int")).alias("rejected"))

    return log.groupBy("page").agg(history.alias("h")).select("page", F.aggregate("h", zero, step).alias("r")).select("page", "r.*")


def recover(runs: DataFrame) -> DataFrame:
    """Interrupted runs go over failed to prepared: run, state, path."""
    stuck = F.col("state").isin("running", "finalizing")
    back = stuck | (F.col("state") == "failed")
    path = F.when(stuck, F.array(F.col("state"), F.lit("failed"), F.lit("prepared"))).when(back, F.array(F.col("state"), F.lit("prepared"))).otherwise(F.array("state"))
    return runs.select("run", F.when(back, "prepared").otherwise(F.col("state")).alias("state"), path.alias("path"))


def reset_pages(pages: DataFrame) -> DataFrame:
    """page, state, problem: what a new analysis makes of each page.

    Untouched pages become pending; finished ones stay; pages in work are refused.
    """
    s = F.col("state")
    new = F.when(s.isin("pending", "analyzed", "failed"), "pending").when(s.isin("preserved", "replaced", "preserved_with_warning"), s)
    return pages.select("page", F.coalesce(new, s).alias("state"), F.when(new.isNull(), F.concat(F.lit("cannot reset "), s)).alias("problem"))


def freeze(nodes: DataFrame, reports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """nodes after a round: accepted become frozen, rejected pending, and frozen ones that a
    failing report depends on are opened again.  reports: page, node, accepted."""
    opened = dependencies.select("page", "node").distinct().withColumn("_o", F.lit(True))
    both = nodes.join(reports.select("page", "node", "accepted"), ["page", "node"], "left").join(opened, ["page", "node"], "left")
    state = F.when(F.col("accepted"), "frozen").when(F.col("accepted") == F.lit(False), "pending").when(F.col("_o") & (F.col("state") == "frozen"), "pending").otherwise(F.col("state"))
    return both.withColumn("state", state).drop("_o", "accepted")


def fallback_required(nodes: DataFrame) -> DataFrame:
    """page, parents: distinct sorted parents of nodes that still fail."""
    open_ = nodes.filter("state in ('pending', 'failed') and kind <> 'text'").select("page", F.coalesce("parent", "node").alias("p"))
    return open_.groupBy("page").agg(F.array_sort(F.collect_set("p")).alias("parents"))


def parent_fallback(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """page, phase: all expected parents reported and accepted, else a warning."""
    got = reports.groupBy("page").agg(F.bool_and("accepted").alias("ok"), F.count_distinct("node").alias("n"))
    both = expected.join(got, "page", "left")
    done = F.coalesce("ok", F.lit(False)) & (F.coalesce("n", F.lit(0)) == F.size("parents"))
    return both.select("page", F.when(done, "ready_for_assembly").otherwise("preserved_with_warning").alias("phase"))


def ready(states: DataFrame) -> DataFrame:
    """Pages whose components are all frozen or inactive: page, phase."""
    return states.groupBy("page").agg(F.when(F.bool_and(F.col("state").isin("frozen", "inactive")), "ready_for_assembly").otherwise("request_published").alias("phase"))


def preserved_warning(states: DataFrame, reason: str) -> DataFrame:
    """The terminal warning: phase, status and reason are set and the revision rises by 1."""
    return states.select("page", (F.col("revision") + 1).alias("revision"), F.lit("preserved_with_warning").alias("phase"), F.lit("preserved_with_warning").alias("status"), F.lit(reason).alias("fallback_reason"))


def resumable(states: DataFrame) -> DataFrame:
    """Warning pages that may go on: stopped by a limit, below it, with failed nodes pending.

    states: page, round, fallback_reason, failed array<long>.
    """
    return states.filter(F.col("fallback_reason").isin("round_limit", "no_progress") & (F.col("round") < MOST_ROUNDS) & (F.size("failed") > 0))


def blocking(violations: Column) -> Column:
    return F.array_except(violations, F.array(F.lit("pptx_reopen_unknown")))


def repairable(violations: Column, names: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_intersect(violations, F.array(*[F.lit(n) for n in names])))


def status(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: pages by state, open and finished components."""
    p = pages.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    n = nodes.agg(F.count_if(F.col("state").isin("frozen", "inactive")).alias("done"), F.count_if(~F.col("state").isin("frozen", "inactive")).alias("open"))
    return p.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("pages")).crossJoin(n)  # two single rows


def record_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """page, object, decision, verdict for new decisions: recorded, repeated or refused.

    A replacement needs the right category and confidence, and a page takes one.
    """
    from docloom.functions.quality import eligible_replacement

    fine = (F.col("decision") == "preserve") | eligible_replacement(F.col("decision"), F.col("category"), F.col("confidence"))
    same = old.select("page", "object", F.col("decision").alias("_d"))
    other = old.filter("decision = 'replace'").groupBy("page").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("page", "decision").orderBy("object")
    both = new.withColumn("_r", F.row_number().over(w)).join(same, ["page", "object"], "left").join(other, "page", "left")
    taken = (F.col("decision") == "replace") & ((F.coalesce("_n", F.lit(0)) > 0) | (F.col("_r") > 1))
    verdict = F.when(F.col("_d") == F.col("decision"), "repeated").when(F.col("_d").isNotNull() | ~fine | taken, "refused").otherwise("recorded")
    return both.select("page", "object", "decision", verdict.alias("verdict"))


def record_plans(plans: DataFrame, incoming: DataFrame) -> DataFrame:
    """page, verdict for plans (page, request_sha256, plan_sha256, retry_due): an equal one
    is repeated, another is refused unless a retry is due, the request must match."""
    old = plans.select("page", F.col("request_sha256").alias("r"), F.col("plan_sha256").alias("p"), F.col("retry_due"))
    both = incoming.join(old, "page", "left")
    verdict = F.when(F.col("r").isNull() | (F.col("r") != F.col("request_sha256")), "wrong_request").when(F.col("p").isNull(), "recorded").when(F.col("p") == F.col("plan_sha256"), "repeated").when(F.col("retry_due"), "recorded").otherwise("refused")
    return both.select("page", verdict.alias("verdict"))
