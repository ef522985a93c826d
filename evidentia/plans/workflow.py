"""Workflow plans as data: nodes and edges from inputs, allowed transitions, readiness, closures, cache keys and estimates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest
from ..sources.tables import written

#: Node states that may follow each state; states that end a node are followed by none.
NODE_TRANSITIONS = {
    "PENDING": ("READY", "BLOCKED", "SKIPPED", "CANCELLED"),
    "READY": ("QUEUED", "CACHED", "BLOCKED", "SKIPPED", "CANCELLED"),
    "QUEUED": ("RUNNING", "FAILED", "CANCELLED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "CACHED", "SKIPPED", "BLOCKED", "CANCELLED"),
    "FAILED": ("READY", "CANCELLED"),
    "BLOCKED": ("PENDING", "READY", "CANCELLED"),
}
DONE = ("SUCCEEDED", "CACHED")
STOPPED = ("FAILED", "BLOCKED", "CANCELLED", "SKIPPED")
TERMINAL = (*DONE, *STOPPED)
#: Rounds whose results are read apart before they are written as one table.
ROUNDS = 16


@dataclass(frozen=True)
class Inputs:
    """What a run has been given. Half of the pair of targets and their mapping is an error."""

    compounds: bool = False
    genes: bool = False
    targets: bool = False
    mapping: bool = False
    comparisons: int = 0
    expression_skipped: bool = False
    batches: tuple[str, ...] | None = None
    species: str = "human"


@dataclass(frozen=True)
class Node:
    """A task of a plan with the (node, task) that it waits for; the task "*" stands for all tasks that a fan-out will make."""

    node: str
    task: str = "main"
    stage: str = "preparation"
    waits: tuple[tuple[str, str], ...] = ()
    state: str = "PENDING"
    skip_reason: str | None = None
    parameters: tuple[tuple[str, object], ...] = ()


@dataclass
class Plan:
    """Nodes in an order that respects what they wait for, and the fan-out that is still open or made."""

    mode: str
    evidence: str
    nodes: list[Node] = field(default_factory=list)
    readiness: dict[str, tuple[str, str]] = field(default_factory=dict)

    def keys(self) -> list[tuple[str, str]]:
        return [(n.node, n.task) for n in self.nodes]

    def edges(self) -> list[tuple[str, str, str, str]]:
        return [(d, t, n.node, n.task) for n in self.nodes for d, t in n.waits]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(nodes (node, task, stage, state), edges (before, before_task, after, after_task))."""
        nodes = spark.createDataFrame([(n.node, n.task, n.stage, n.state) for n in self.nodes], "node string, task string, stage string, state string")
        return nodes, spark.createDataFrame(self.edges(), "before string, before_task string, after string, after_task string")


#: The evidence modules, and those that need a gene set.
MODULES = ("gene_mapping", "netinfer", "proximity", "kg", "gps")
GENE_MODULES = ("gene_mapping", "proximity", "kg")


def module_readiness(inputs: Inputs, supported: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, str]]:
    """(status, reason) of each evidence module: unsupported species, blocked without genes, skipped without expression data, else available."""
    supported = supported or {m: ("human",) for m in MODULES}
    out = {}
    for m in MODULES:
        if inputs.species not in supported.get(m, ()):
            out[m] = ("unsupported", f"no resources for {inputs.species}")
        elif m in GENE_MODULES and not inputs.genes:
            out[m] = ("blocked", "a gene set is required")
        elif m == "gps" and not inputs.comparisons:
            out[m] = ("skipped", "no expression data; the core evidence stays usable")
        else:
            out[m] = ("available", f"resources for {inputs.species}")
    return out


def build_plan(inputs: Inputs, seeds: tuple[int, ...]) -> Plan:
    """The nodes that the inputs call for; expression data add the signature stream, given targets replace the inferred ones.

    Where the batches of the inference are not known yet, the merge waits for the task "*" of the batch node.
    """
    missing = [n for n, there in (("compounds", inputs.compounds), ("disease_genes", inputs.genes)) if not there]
    if not missing and inputs.targets != inputs.mapping:
        missing = ["target_mapping" if inputs.targets else "drug_targets"]
    if missing:
        raise ValueError(f"required inputs are missing: {missing}")
    if not seeds or len(set(seeds)) < len(seeds):
        raise ValueError("seeds must be there and be unique")
    readiness = module_readiness(inputs)
    if bad := [m for m in (*GENE_MODULES, "netinfer") if readiness[m][0] == "unsupported"]:
        raise ValueError(f"unsupported by the resources: {bad}")
    enhanced = readiness["gps"][0] == "available"
    plan = Plan(f"{'provided_targets_' if inputs.targets else ''}{'enhanced' if enhanced else 'core'}", "kg_proximity_gps" if enhanced else "kg_proximity", readiness=readiness)

    def add(node: str, stage: str, *waits: str | tuple[str, str], **more) -> None:
        plan.nodes.append(Node(node, stage=stage, waits=tuple((w, "main") if isinstance(w, str) else w for w in waits), **more))

    def skip(reason: str, *nodes: tuple[str, str]) -> None:
        for node, stage in nodes:
            add(node, stage, state="SKIPPED", skip_reason=reason)

    add("create_run_workspace", "preparation", state="SUCCEEDED")
    add("register_inputs", "preparation", "create_run_workspace")
    add("prepare_compound_library", "preparation", "register_inputs")
    add("prepare_disease_genes", "preparation", "register_inputs")
    gps = (("prepare_expression_inputs", "preparation"), ("gps_predict_drug_profiles", "gps"), ("gps_build_disease_signature", "gps"), ("gps_score_compounds", "gps"))
    if enhanced:
        add("prepare_expression_inputs", "preparation", "register_inputs")
        add("gps_predict_drug_profiles", "gps", "prepare_compound_library")
        add("gps_build_disease_signature", "gps", "prepare_expression_inputs", "gps_predict_drug_profiles")
        add("gps_score_compounds", "gps", "gps_predict_drug_profiles", "gps_build_disease_signature")
    else:
        skip("expression data skipped by the user" if inputs.expression_skipped else readiness["gps"][1], *gps)
    inference = ("netinfer_prepare_inputs", "netinfer_predict_known", "netinfer_predict_batch", "netinfer_merge_targets")
    if inputs.targets:
        add("import_drug_targets", "preparation", "register_inputs", "prepare_compound_library")
        skip("given targets are used", *[(n, "netinfer") for n in inference])
        readiness["netinfer"] = ("skipped", "given targets are used")
        targets = ["import_drug_targets"]
    else:
        add("netinfer_prepare_inputs", "netinfer", "prepare_compound_library")
        add("netinfer_predict_known", "netinfer", "netinfer_prepare_inputs")
        for b in inputs.batches or ():
            add("netinfer_predict_batch", "netinfer", "netinfer_prepare_inputs", task=b, parameters=(("batch_id", b),))
        made = [("netinfer_predict_batch", b) for b in inputs.batches] if inputs.batches is not None else [("netinfer_predict_batch", "*")]
        add("netinfer_merge_targets", "netinfer", "netinfer_prepare_inputs", "netinfer_predict_known", *made)
        targets = ["netinfer_prepare_inputs", "netinfer_merge_targets"]
    add("proximity_prepare_network", "proximity", "prepare_disease_genes", *targets)
    add("proximity_score_compounds", "proximity", "proximity_prepare_network")
    add("kg_construct_graph", "kg", "prepare_compound_library", "prepare_disease_genes", *targets)
    add("kg_prepare_training_data", "kg", "kg_construct_graph")
    add("kg_pretrain", "kg", "kg_prepare_training_data")
    for s in seeds:
        add("kg_finetune_seed", "kg", "kg_prepare_training_data", "kg_pretrain", task=f"seed-{s}", parameters=(("seed", s),))
    add("kg_aggregate_seeds", "kg", *[("kg_finetune_seed", f"seed-{s}") for s in seeds])
    add("rank_candidates", "final", "kg_aggregate_seeds", "proximity_score_compounds", *(["gps_score_compounds"] if enhanced else []), parameters=(("evidence_mode", plan.evidence),))
    add("generate_run_report", "final", "rank_candidates")
    return plan


def fan_out(plan: Plan, node: str, items: tuple[str, ...], source: str, stage: str) -> Plan:
    """``plan`` with a task of ``node`` per item, and "*" replaced by them. The same items again change nothing; others are an error."""
    if len(set(items)) < len(items):
        raise ValueError("items must be unique")
    made = tuple(n.task for n in plan.nodes if n.node == node and n.state != "SKIPPED")
    if made:
        if made != tuple(items):
            raise ValueError("the fan-out has been made with other items")
        return plan
    at = next(i for i, n in enumerate(plan.nodes) if (node, "*") in n.waits)
    fresh = [Node(node, i, stage, ((source, "main"),)) for i in items]
    rest = [Node(n.node, n.task, n.stage, tuple(w for x in n.waits for w in ([(node, i) for i in items] if x == (node, "*") else [x])), n.state, n.skip_reason, n.parameters) for n in plan.nodes[at:]]
    return Plan(plan.mode, plan.evidence, [*plan.nodes[:at], *fresh, *rest], plan.readiness)


def cache_key(inputs: dict[str, str], config: dict, code: str, resources: dict[str, str], parameters: dict) -> str:
    """The name of a node's result: a digest of all it depends on."""
    return digest({"inputs": inputs, "config": config, "code": code, "resources": resources, "parameters": parameters})


def transitions_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in NODE_TRANSITIONS.items() for b in bs], "before string, after string")


def allowed(before: str, after: str, invalidation: bool = False) -> bool:
    """Whether a node may go from one state to another; an invalidation takes any ended node back to PENDING."""
    if invalidation:
        return after == "PENDING" and before in TERMINAL
    return before != after and after in NODE_TRANSITIONS.get(before, ())


def violations(log: DataFrame, allowed: DataFrame, node: str, state: str, *order: str) -> DataFrame:
    """Steps of a node's log whose pair of states is not allowed. log: one row per change."""
    own = Window.partitionBy(node).orderBy(*order)
    steps = log.withColumns({"before": F.lag(state).over(own), "after": F.col(state)}).where("before IS NOT NULL")
    return steps.join(F.broadcast(allowed), ["before", "after"], "left_anti")  # the table of transitions is fixed


def latest(log: DataFrame, node: str, state: str, *order: str) -> DataFrame:
    return log.groupBy(node).agg(F.max_by(state, F.struct(*order)).alias(state))


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, verdict) of pending nodes: BLOCKED if something that they wait for has stopped or gets blocked, READY if all of it is done, else PENDING.

    A node that is waited for but is not there keeps the waiting node PENDING. Blocks pass on until no node changes.
    nodes: (node, state); edges: (before, after).
    """
    state = written(nodes.select("node", "state"), "state")
    waits = written(edges.select("before", "after").distinct(), "waits")
    blocked = None
    while True:
        own = state.select(F.col("node").alias("before"), F.col("state").alias("_state"))
        met = waits.join(own, "before", "left").groupBy(F.col("after").alias("node")).agg(F.max(F.coalesce(F.col("_state").isin(*STOPPED), F.lit(False)).cast("int")).alias("_stopped"), F.min(F.coalesce(F.col("_state").isin(*DONE), F.lit(False)).cast("int")).alias("_done"))
        judged = state.join(met, "node", "left")
        pending = F.col("state") == "PENDING"
        stopped = pending & (F.coalesce("_stopped", F.lit(0)) == 1)
        verdict = F.when(stopped, "BLOCKED").when(pending & (F.coalesce("_done", F.lit(1)) == 1), "READY").otherwise("PENDING")
        judged = written(judged.select("node", F.when(stopped, "BLOCKED").otherwise(F.col("state")).alias("state"), F.when(pending, verdict).alias("verdict")), "judged")
        now = judged.where("state = 'BLOCKED'").count()
        if now == blocked:
            break
        state, blocked = judged.select("node", "state"), now
    return nodes.where("state = 'PENDING'").select("node").join(judged.select("node", "state", "verdict"), "node").select("node", F.when(F.col("state") == "BLOCKED", "BLOCKED").otherwise(F.col("verdict")).alias("verdict"))


def task_edges(edges: DataFrame, tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """(before, after) over "node:task" names, with "*" replaced by the tasks of a fan-out. An open fan-out gives one edge from a task that is not there.

    edges: (before, before_task, after, after_task); tasks: (node, task); resolved: (node) of the fan-outs that have been made.
    """
    name = lambda a, b: F.concat_ws(":", a, b)
    plain = edges.where("before_task <> '*'").select(name("before", "before_task").alias("before"), name("after", "after_task").alias("after"))
    wild = edges.where("before_task = '*'").join(resolved.select(F.col("node").alias("before"), F.lit(True).alias("_made")), "before", "left")
    open_ = wild.where("_made IS NULL").select(name("before", "before_task").alias("before"), name("after", "after_task").alias("after"))
    made = wild.where("_made").join(tasks.select(F.col("node").alias("before"), "task"), "before").select(name("before", "task").alias("before"), name("after", "after_task").alias("after"))
    return reduce(DataFrame.union, [plain, open_, made])


def downstream(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes that a path leads to from the roots. edges: (before, after); roots: (node)."""
    seen = frontier = roots.select("node").distinct()
    step = 0
    while True:
        step += 1
        fresh = edges.join(frontier, edges.before == frontier.node).select(F.col("after").alias("node")).distinct().join(seen, "node", "left_anti")
        fresh = written(fresh, "closure")
        if fresh.isEmpty():
            break
        seen, frontier = seen.union(fresh), fresh
        if step % ROUNDS == 0:
            seen = written(seen, "closure")
    return seen.join(roots.select("node"), "node", "left_anti")


def retry_scope(nodes: DataFrame, edges: DataFrame, chosen: Column | None = None) -> DataFrame:
    """(node, state) after a retry: the failed nodes that are chosen become READY, what follows them and has ended, but for skipped nodes, PENDING.

    No failed node that is chosen is an error. nodes: (node, state); edges: (before, after).
    """
    failed = F.col("state") == "FAILED"
    roots = written(nodes.where(failed if chosen is None else failed & chosen).select("node"), "roots")
    if roots.isEmpty():
        raise ValueError("no failed node to retry")
    after = downstream(edges, roots).select("node", F.lit("PENDING").alias("_next"))
    marks = roots.select("node", F.lit("READY").alias("_next")).unionByName(after)
    ended = F.col("state").isin(*[s for s in TERMINAL if s != "SKIPPED"])
    rows = nodes.join(marks, "node", "left")
    return rows.select("node", F.when(F.col("_next") == "READY", "READY").when((F.col("_next") == "PENDING") & ended, "PENDING").otherwise(F.col("state")).alias("state"))


def eta(history: DataFrame, remaining: DataFrame, task: str = "task", seconds: str = "seconds", reference: DataFrame | None = None) -> DataFrame:
    """(status, low, middle, high, unknown): summed over the remaining tasks; percentiles 20 and 80 from four runs on, else the median times 0.7 and 1.5.

    A task without history takes the range that ``reference`` (task, low, high) has for it; with none the status is
    unknown and there are no sums. No remaining task is an estimate of 0.
    """
    by = history.groupBy(task).agg(F.count(seconds).alias("n"), F.percentile(seconds, F.array(F.lit(0.2), F.lit(0.8))).alias("p"), F.median(seconds).alias("m")).where("n > 0")
    by = by.select(task, F.greatest(F.lit(0.0), F.when(F.col("n") >= 4, F.col("p")[0]).otherwise(F.col("m") * 0.7)).alias("low"), F.col("m").alias("middle"), F.when(F.col("n") >= 4, F.col("p")[1]).otherwise(F.col("m") * 1.5).alias("high"))
    rows = remaining.join(by, task, "left")
    if reference is not None:
        rows = rows.join(reference.select(task, F.col("low").alias("_low"), F.col("high").alias("_high")), task, "left")
        rows = rows.select(task, F.coalesce("low", "_low").alias("low"), F.coalesce("middle", (F.col("_low") + F.col("_high")) / 2).alias("middle"), F.coalesce("high", "_high").alias("high"))
    total = rows.agg(F.coalesce(F.sum(F.col("low").isNull().cast("long")), F.lit(0)).alias("unknown"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("low", "middle", "high")])
    known = F.col("unknown") == 0
    return total.select(F.when(known, "estimated").otherwise("unknown").alias("status"), *[F.when(known, F.col(c)).alias(c) for c in ("low", "middle", "high")], "unknown")


def scale(pairs: DataFrame) -> DataFrame:
    """The geometric mean of actual over expected, between 0.25 and 4. pairs: (actual, expected)."""
    return pairs.where("actual > 0 AND expected > 0").agg(F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.exp(F.avg(F.log(F.col("actual") / F.col("expected")))))).alias("scale"))


def rollup(nodes: DataFrame, run: str, state: str, priority: dict[str, int]) -> DataFrame:
    """(run, status): the state with the highest priority among a run's nodes."""
    order = F.coalesce(*[F.when(F.col(state) == s, F.lit(p)) for s, p in priority.items()], F.lit(-1))
    return nodes.groupBy(run).agg(F.max_by(state, order).alias("status"))


def run_status(nodes: DataFrame, run: str = "run", state: str = "state", cancelled: DataFrame | None = None) -> DataFrame:
    """(run, status) from all its nodes' states: a cancel request once nothing runs, then active work, then a failure, then how a run that is over has ended, else what it waits for.

    cancelled: (run) of the runs with a request to cancel.
    """
    some = lambda *names: F.bool_or(F.col(state).isin(*names))
    over = F.bool_and(F.col(state).isin(*TERMINAL))
    status = F.when(some("RUNNING"), "RUNNING").when(some("QUEUED"), "QUEUED").when(some("FAILED"), "FAILED")
    status = status.when(over & ~some("BLOCKED"), "SUCCEEDED").when(~over & some("READY"), "READY").otherwise("BLOCKED")
    out = nodes.groupBy(run).agg(status.alias("status"))
    if cancelled is None:
        return out
    asked = cancelled.select(run).distinct().withColumn("_cancel", F.lit(True))
    return out.join(asked, run, "left").select(run, F.when(F.coalesce("_cancel", F.lit(False)) & (F.col("status") != "RUNNING"), "CANCELLED").otherwise(F.col("status")).alias("status"))


def progress(nodes: DataFrame, run: str = "run") -> DataFrame:
    """(run, total, complete, uncertain, percent, started_at, finished_at): ended nodes count 1, others their own progress between 0 and 1; those without one are uncertain. nodes: (run, state, progress, started_at, finished_at)."""
    ended = F.col("state").isin(*TERMINAL)
    units = F.when(ended, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("progress", F.lit(0.0)))))
    return nodes.groupBy(run).agg(
        F.count("*").alias("total"), F.sum(ended.cast("long")).alias("complete"), F.sum((~ended & F.col("progress").isNull()).cast("long")).alias("uncertain"),
        F.floor(F.sum(units) / F.count("*") * 100 + 0.5).cast("int").alias("percent"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
    )


def module_status(nodes: DataFrame, run: str = "run", module: str = "stage") -> DataFrame:
    """(run, module, status) with the first state of a fixed order that a module's nodes have."""
    order = {s: len(MODULE_ORDER) - i for i, s in enumerate(MODULE_ORDER)}
    return nodes.groupBy(run, module).agg(F.max_by("state", F.coalesce(*[F.when(F.col("state") == s, F.lit(p)) for s, p in order.items()], F.lit(0))).alias("status"))


#: Which state of its nodes stands for a module.
MODULE_ORDER = ("FAILED", "BLOCKED", "RUNNING", "QUEUED", "READY", "PENDING", "CANCELLED", "SUCCEEDED", "CACHED", "SKIPPED")


def checklist(uploaded: set[str], pairs: dict[str, set[str]]) -> dict[str, object]:
    """What a run still needs: states of the inputs, the next required one, the evidence mode and where targets come from.

    uploaded: keys of the inputs that are there; pairs: roles (tpm, metadata) of the expression files by suffix.
    """
    whole = [p for p, roles in pairs.items() if {"tpm", "metadata"} <= roles]
    expression = "incomplete" if len(whole) < len(pairs) else "available" if whole else "skipped"
    given = [k in uploaded for k in ("drug_targets", "target_mapping")]
    target = "provided" if all(given) else "incomplete" if any(given) else "generated"
    state = {k: "available" if v in uploaded else "missing" for k, v in (("compounds", "compound_library"), ("disease_genes", "disease_genes"))}
    state |= {k: "available" if k in uploaded else "optional" for k in ("drug_targets", "target_mapping", "positive_drugs", "disease_links")}
    needed = next((k for k in ("compounds", "disease_genes") if state[k] == "missing"), None)
    needed = needed or (("target_mapping" if given[0] else "drug_targets") if target == "incomplete" else None) or ("expression_pair" if expression == "incomplete" else None)
    return {"inputs": {**state, "target_pair": target, "expression_pair": expression}, "next_required": needed, "ready": needed is None, "evidence_mode": "kg_proximity_gps" if expression == "available" else "kg_proximity", "target_source": "provided" if target == "provided" else "inferred"}
