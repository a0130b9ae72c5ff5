"""Workflows: nodes linked to a graph, checked, and run in topological order over one lazy plan.

Nodes take and give a context of DataFrames. Scorers of Column form that are next to each other in the
order become one projection; nothing runs on the cluster before a sink asks for rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.model import RunConfig
from scorelake.operators import external, scoring
from scorelake.operators.ledger import Ledger
from scorelake.operators.rows import pinned, reindexed, sliced
from scorelake.sinks.reports import report

#: Metrics that one function may give.
WIDTH = 1000
INIT, RUNNING, DONE, FAILED = "INIT", "RUNNING", "DONE", "FAILED"


@dataclass
class Context:
    """What nodes share. ledger: where answers of the system under test are kept from run to run. scorers: those in column form; row_scorers: functions that give long scorer results; results: all scorers' results, once asked for."""

    strategy: str = "sum"
    threshold: float = 0.0
    items: DataFrame | None = None
    api_results: DataFrame | None = None
    results: DataFrame | None = None
    counts: dict[str, DataFrame] = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    scorers: list[scoring.Scorer] = field(default_factory=list)
    row_scorers: list[tuple[int, Callable[[DataFrame, str], DataFrame]]] = field(default_factory=list)
    config: RunConfig = field(default_factory=RunConfig)
    ledger: Ledger | None = None

    def rows(self) -> DataFrame:
        """Items with their API results, if there are any."""
        return self.items if self.api_results is None else self.items.join(self.api_results, "data_index", "left")

    def scored(self) -> DataFrame:
        """Long results of all scorers: those in column form in one pass over the items, and those of functions, by their order in the workflow.

        Functions may ask systems outside, so results with theirs are written once, and all that read them read that table.
        """
        if self.results is None:
            kind = scoring.strategy(self.strategy).kind
            taken = {pos for pos, _ in self.row_scorers}
            free = [pos for pos in range(len(self.scorers) + len(taken)) if pos not in taken]
            parts = []
            if self.scorers:
                place = F.element_at(F.array(*map(F.lit, free)), F.col("scorer_pos") + 1)
                parts.append(scoring.score_items(self.rows(), self.scorers, kind).withColumn("scorer_pos", place))
            # a function may give several metrics, which share its position and are told apart by a fraction of it in their order
            for pos, score in self.row_scorers:
                parts.append(score(self.rows(), kind).withColumn("scorer_pos", F.lit(pos) * WIDTH + F.col("scorer_pos")))
            if self.row_scorers and self.scorers:
                parts[0] = parts[0].withColumn("scorer_pos", F.col("scorer_pos") * WIDTH)
            made = reduce(DataFrame.unionByName, parts) if parts else scoring.score_items(self.rows(), [], kind)
            self.results = pinned(made) if self.row_scorers else made
        return self.results

    def verdicts(self, **how) -> DataFrame:
        """One verdict per item; without functions among the scorers they are folded inside each row."""
        if self.results is None and self.scorers and not self.row_scorers:
            return scoring.item_verdicts(self.rows(), self.scorers, self.strategy, self.threshold, **how)
        return scoring.verdicts(self.scored(), self.strategy, self.threshold, items=self.items, **how)


class Node:
    """A named step; run changes the context, hooks may be overridden."""

    def __init__(self, run: Callable[[Context], None] | None = None, name: str = ""):
        self.id, self.name, self._run = name or uuid.uuid4().hex, name, run

    def before(self, context: Context) -> None: ...

    def after(self, context: Context) -> None: ...

    def failed(self, context: Context, error: Exception) -> None: ...

    def run(self, context: Context) -> None:
        if self._run:
            self._run(context)

    def execute(self, context: Context) -> None:
        self.before(context)
        try:
            self.run(context)
        except Exception as e:
            self.failed(context, e)
            raise
        self.after(context)


class Begin(Node):
    def __init__(self, strategy: str = "sum", threshold: float = 0.0):
        scoring.strategy(strategy)
        super().__init__(lambda c: (setattr(c, "strategy", strategy), setattr(c, "threshold", threshold)) and None)


class Load(Node):
    """The items of a run; those that its config's offset and limit leave, indexed anew if these say anything."""

    def __init__(self, source: Callable[[], DataFrame]):
        def run(c: Context) -> None:
            c.items = paged(source(), c.config)

        super().__init__(run)


def paged(items: DataFrame, config: RunConfig) -> DataFrame:
    """The page of offset and limit in the order of data_index; as anywhere, without a limit the offset doesn't count."""
    return reindexed(sliced(items, ["data_index"], config.offset, config.limit), ["data_index"]) if config.limit >= 0 else items


class Wrap(Node):
    def __init__(self, change: Callable[[DataFrame], DataFrame]):
        super().__init__(lambda c: setattr(c, "items", change(c.items)))


class Call(Node):
    """An API over all items; its results are written when ``persist`` is set, for sinks read them again.

    call takes the items, or a Transport's factory is given: then the run's thread_num says how many
    calls a partition makes at a time, and answers come from the run's ledger where it has one. A call that
    takes more than ``timeout`` seconds costs its own case only.
    """

    def __init__(self, call: Callable[[DataFrame], DataFrame] | None = None, persist: bool = True, factory: Callable[[], external.Transport] | None = None, timeout: float | None = None):
        def run(c: Context) -> None:
            made = call(c.items) if call else external.api_completion(c.items, factory, threads=c.config.thread_num, timeout=timeout, ledger=c.ledger)
            c.api_results = pinned(made) if persist else made

        if (call is None) == (factory is None):
            raise ValueError("either call or factory must be given")
        super().__init__(run)


class Score(Node):
    """A scorer: in column form, or a function of the rows and the kind of strategy that gives long scorer results, as those of judged do."""

    def __init__(self, scorer: scoring.Scorer | Callable[[DataFrame, str], DataFrame]):
        def run(c: Context) -> None:
            c.results = None
            if isinstance(scorer, scoring.Scorer):
                c.scorers.append(scorer)
            else:
                c.row_scorers.append((len(c.scorers) + len(c.row_scorers), scorer))

        super().__init__(run)


class Count(Node):
    """A named count of the run; a failing one is left out."""

    def __init__(self, name: str, count: Callable[[Context], DataFrame]):
        super().__init__(lambda c: report(lambda: c.counts.__setitem__(name, count(c))) and None)


class Report(Node):
    """A sink; failures are logged and the run goes on. Without items it is an error."""

    def __init__(self, sink: Callable[[Context], object]):
        def run(c: Context) -> None:
            if c.items is None:
                raise ValueError("there are no items to report")
            report(lambda: sink(c))

        super().__init__(run)


class End(Node):
    def __init__(self, callback: Callable[[Context], None]):
        super().__init__(callback)


class Workflow:
    def __init__(self, order: list[Node], context: Context | None = None):
        self.order, self.context, self.status = order, context or Context(), INIT

    def execute(self) -> Context:
        self.status = RUNNING
        try:
            for node in self.order:
                node.execute(self.context)
        except Exception:
            self.status = FAILED
            raise
        self.status = DONE
        return self.context

    def clone(self) -> "Workflow":
        return Workflow(self.order, replace(self.context, counts=dict(self.context.counts), values=dict(self.context.values), scorers=list(self.context.scorers), row_scorers=list(self.context.row_scorers)))


class WorkflowBuilder:
    def __init__(self):
        self.nodes: dict[str, Node] = {}
        self.before: dict[str, set[str]] = {}

    def add(self, *nodes: Node) -> "WorkflowBuilder":
        for n in nodes:
            self.nodes.setdefault(n.id, n)
            self.before.setdefault(n.id, set())
        return self

    def link(self, *steps: Node | Iterable[Node]) -> "WorkflowBuilder":
        """Each node of a step runs after all of the step before; a step is a node or several."""
        if not steps:
            raise ValueError("nothing to link")
        groups = [[s] if isinstance(s, Node) else [*s] for s in steps]
        if not all(groups):
            raise ValueError("a step has no nodes")
        for a, b in zip(groups, groups[1:], strict=False):
            self.add(*a, *b)
            for n in b:
                self.before[n.id] |= {x.id for x in a}
        return self

    def build(self, context: Context | None = None) -> Workflow:
        try:
            order = [*TopologicalSorter(self.before).static_order()]
        except CycleError as e:
            raise ValueError("the graph has a cycle") from e
        # of nodes that may run in any order, those linked first come first
        rank = {k: i for i, k in enumerate(self.nodes)}
        depth: dict[str, int] = {}
        for k in order:
            depth[k] = 1 + max((depth[b] for b in self.before[k]), default=-1)
        return Workflow([self.nodes[k] for k in sorted(order, key=lambda k: (depth[k], rank[k]))], context)


@dataclass
class FullRun:
    """load, evaluation workflow, report workflow; hooks before and after the whole and each part.

    Of the config, offset and limit page the loaded items, thread_num is for calls by factory,
    strategy and pass_score are for verdicts.
    """

    config: RunConfig
    load: Callable[[], DataFrame]
    evaluation: list[Node]
    reports: list[Node] = field(default_factory=list)
    hooks: dict[str, Callable[[Context], None]] = field(default_factory=dict)
    ledger: Ledger | None = None

    def run(self) -> Context:
        context = Context(strategy=self.config.strategy, threshold=self.config.pass_score, config=self.config, ledger=self.ledger)
        hook = lambda name: self.hooks.get(name, lambda c: None)(context)
        hook("before")
        for name, part in (("load", [Load(self.load)]), ("evaluation", self.evaluation), ("report", self.reports)):
            hook(f"before_{name}")
            if part:
                builder = WorkflowBuilder()
                (builder.link(*part) if len(part) > 1 else builder.add(*part)).build(context).execute()
            hook(f"after_{name}")
        hook("after")
        return context
