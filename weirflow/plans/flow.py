"""Declaring flows and lowering them to DataFrames.

A builder records sources, maps, joins, operators, stateful folds, span joins, registered
components and sinks; ``build`` checks deadlines and freezes the graph; ``lower`` turns it
into one lazy DataFrame a channel, which Catalyst plans as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.functions import lineage as L
from weirflow.operators import dataflow as O
from weirflow.operators.numbering import number

from . import ir, registry, sla


@dataclass(frozen=True)
class Decl:
    kind: str
    inputs: tuple[str, ...]
    output: str
    plan: Callable | None = None
    state: str = ""
    interval_us: int = 0
    via: str = ""


class Chain:
    """A channel while the flow is declared. An invalid chain (an unknown component) is false."""

    def __init__(self, flow: FlowBuilder, channel: str, valid: bool = True):
        self.flow, self.channel, self._valid = flow, channel, valid

    def valid(self) -> bool:
        return self._valid

    __bool__ = valid

    def map(self, **columns: Column) -> Chain:
        return self.flow._add("map", (self.channel,), self.flow._anonymous(), lambda c, d: O.map_rows(d, c, **columns))

    def map_to(self, name: str, **columns: Column) -> Chain:
        return self.flow._add("map", (self.channel,), self.flow._named(name), lambda c, d: O.map_rows(d, c, **columns))

    def op(self, emit: Column, init: Column | None = None) -> Chain:
        return self.flow._add("op", (self.channel,), self.flow._anonymous(), lambda c, d: O.op(d, c, emit, init))

    def sink(self, fn: Callable[[DataFrame], object] | None = None) -> Chain:
        """``fn`` gets the channel's DataFrame when the flow runs; any number of sinks may share a channel."""
        self.flow._decls.append(Decl("sink", (self.channel,), "", fn))
        return self

    def with_wcet(self, us: int) -> Chain:
        self.flow._wcet[self.channel] = us
        return self

    def with_sla(self, deadline_us: int | str) -> Chain:
        """A deadline in µs. Text is accepted as a note and plans nothing."""
        if not isinstance(deadline_us, str):
            self.flow._endpoints.append((self.channel, deadline_us))
        return self


class FlowBuilder:
    def __init__(self, name: str):
        self.name = name
        self._decls: list[Decl] = []
        self._wcet: dict[str, int] = {}
        self._endpoints: list[tuple[str, int]] = []
        self._config = sla.Config()
        self._fallback = ""
        self._count = 0

    def _anonymous(self) -> str:
        self._count += 1
        return f"{self.name}/~{self._count - 1}"

    def _named(self, name: str) -> str:
        return name if "/" in name else f"{self.name}/{name}"

    def _add(self, kind: str, inputs: tuple[str, ...], output: str, plan: Callable, **more) -> Chain:
        self._decls.append(Decl(kind, inputs, output, plan, **more))
        return Chain(self, output)

    def source(self, name: str, rows: Callable[[SparkSession], DataFrame] | None = None, order: Sequence[str] = ("ts_ns",), interval_us: int = 0, ticks: int = 0) -> Chain:
        """``rows`` gives a table with ``ts_ns`` (and ``arrival``, else it is its place in ``order``).

        Without ``rows`` the source is periodic: ``ticks`` messages, one each ``interval_us``.
        """
        channel = self._named(name)

        def plan(c: str, spark: SparkSession) -> DataFrame:
            if rows is None:
                return O.generate(spark, c, ticks, interval_us)
            df = O.source(rows(spark), c, order)
            return df if "arrival" in df.columns else df.withColumn("arrival", F.col("seq"))

        return self._add("source", (), channel, plan, interval_us=interval_us)

    def tap(self, name: str) -> Chain:
        """A channel that is given when the flow is lowered, or produced elsewhere in it."""
        return Chain(self, self._named(name))

    def join(self, a: Chain, b: Chain, fn: Callable, depth: int | None = None) -> Chain:
        """The n-th message of one with the n-th of the other. With ``depth`` (``QUEUE``, say) a queue that is full drops its oldest message."""

        def plan(c: str, x: DataFrame, y: DataFrame) -> DataFrame:
            return O.zip_join(x, y, c, fn) if depth is None else O.zip_dropping(x, y, c, fn, depth)

        return self._add("join", (a.channel, b.channel), self._anonymous(), plan)

    def fuse(self, chains: Sequence[Chain], fn: Callable) -> Chain:
        """The n-th messages of two to four channels."""
        return self._add("join", tuple(c.channel for c in chains), self._anonymous(), lambda c, *d: O.zip_many(d, c, fn))

    def span_join(
        self, trigger: Chain, data: Chain, span: tuple[Column, Column], width: int, time: str = "ts_ns", history: int | None = None, folds: dict | None = None
    ) -> Chain:
        """The slice of each trigger, or with ``folds`` its ``n`` and folds."""
        made = lambda c, t, d: O.span_join(t, d, c, data.channel, span, width, time, history, folds)
        return self._add("span", (trigger.channel, data.channel), self._anonymous(), made)

    def span_aggregate(self, trigger: Chain, data: Chain, span: tuple[Column, Column], width: int, reduce: dict[str, Column], time: str = "ts_ns") -> Chain:
        """Reductions of the slice of each trigger, beside ``n``, ``seq_lo`` and ``seq_hi``."""
        made = lambda c, t, d: O.span_aggregate(t, d, c, data.channel, span, width, reduce, time)
        return self._add("span", (trigger.channel, data.channel), self._anonymous(), made)

    def fold(self, chain: Chain, name: str, zero: Callable[[], object], step: Callable, schema: str, keys: Sequence[str] = ()) -> Chain:
        """An operator with state, or a loop closed over its own last output: ``step(state, row) -> state, outputs``."""
        return self._add("op", (chain.channel,), self._named(name), lambda c, d: O.fold_op(d, c, zero, step, schema, keys))

    def stateful(self, chain: Chain, out: str, state: str, folds: dict, columns: dict[str, Column]) -> tuple[Chain, Chain]:
        out, state = self._named(out), self._named(state)
        self._add("stateful", (chain.channel,), out, lambda c, d: O.stateful(d, c, state, folds, columns), state=state)
        return Chain(self, out), Chain(self, state)

    def from_(self, name: str, *inputs: Chain, interval_us: int = 0, output: str = "") -> Chain:
        """A registered component over none, one or two channels; unknown names give an invalid chain."""
        fn = registry.get_component(name, len(inputs))
        if fn is None:
            return Chain(self, "", valid=False)
        channel = self._named(output) if output else self._anonymous()
        needs = registry.needs_of(name)
        if not inputs:

            def plan(c: str, spark: SparkSession) -> DataFrame:
                df = O.source(fn(spark), c, ["ts_ns"])
                return df if "arrival" in df.columns else df.withColumn("arrival", F.col("seq"))

            return self._add("from", (), channel, plan, interval_us=interval_us, via=name)
        return self._add("from", tuple(i.channel for i in inputs), channel, lambda c, *d: _component(c, fn, d, needs, name), via=name)

    def with_sla_config(self, **settings) -> FlowBuilder:
        self._config = sla.Config(**settings)
        return self

    def with_fallback(self, name: str) -> FlowBuilder:
        self._fallback = name
        return self

    def build(self) -> Flow:
        if self._fallback and (self._fallback == self.name or not registry.has_flow(self._fallback)):
            raise ValueError(f"fallback flow '{self._fallback}' is not another registered flow")
        sources = {d.output: d.interval_us for d in self._decls if d.kind in ("source", "from") and not d.inputs}
        nodes = [sla.Node(d.kind, d.inputs, c, self._wcet.get(c, 0)) for d in self._decls if d.inputs for c in (d.output, d.state) if c]
        report = sla.plan(sources, nodes, self._endpoints, self._config)
        if not report.ok:
            v = report.violations
            raise sla.DeadlineError(
                f"{v[0].endpoint}: planned {v[0].planned_us} us > deadline {v[0].deadline_us} us on {' <- '.join(v[0].path)}, worst {v[0].worst}"
                if v
                else report.saturation
            )
        return Flow(self.name, tuple(self._decls), dict(self._wcet), tuple(self._endpoints), report, self._fallback)


def _component(channel: str, fn: Callable, inputs: Sequence[DataFrame], needs: Sequence[str], name: str) -> DataFrame:
    """One input: rows of the result derive from it; two: the component maps the zipped pairs."""
    for df, ddl in zip(inputs, needs, strict=False):
        for f in StructType.fromDDL(ddl).fields:
            if f.name not in df.columns or df.schema[f.name].dataType != f.dataType:
                found = df.schema[f.name].dataType.simpleString() if f.name in df.columns else "missing"
                raise ValueError(f"component {name} needs {f.name} {f.dataType.simpleString()}, which is {found}")
    if len(inputs) == 2:
        return O.zip_join(*inputs, channel, fn)
    made = fn(inputs[0])
    out = number(made.drop("seq"), ["arrival"])
    return out.withColumn("lineage", L.add_hop("lineage", channel, "seq"))


@dataclass(frozen=True)
class Flow:
    name: str
    decls: tuple[Decl, ...]
    wcet: dict[str, int] = field(default_factory=dict)
    endpoints: tuple[tuple[str, int], ...] = ()
    report: sla.Report = field(default_factory=sla.Report)
    fallback: str = ""

    def describe(self) -> str:
        """The wiring on one line, by kind and then as declared."""

        def text(d: Decl) -> str:
            match d.kind:
                case "source":
                    return f"src[{d.output}]"
                case "join":
                    return f"join[{' + '.join(d.inputs)} -> {d.output}]"
                case "stateful":
                    return f"stateful[{d.inputs[0]} -> {d.output} + {d.state}]"
                case "span":
                    return f"span[{d.inputs[0]} x {d.inputs[1]} -> {d.output}]"
                case "from":
                    way = " + ".join(d.inputs)
                    return f"from[{way} via {d.via} -> {d.output}]" if way else f"from[{d.via} -> {d.output}]"
                case "sink":
                    return f"sink[{d.inputs[0]}]"
            return f"{d.kind}[{d.inputs[0]} -> {d.output}]"

        kinds = ["source", "map", "join", "op", "stateful", "span", "from", "sink"]
        return " ".join([f"flow {self.name}:", *(text(d) for k in kinds for d in self.decls if d.kind == k)])

    def graph(self) -> ir.Graph:
        nodes = [ir.Node("source" if d.kind == "from" and not d.inputs else d.kind, d.inputs, d.output, "row", self.wcet.get(d.output, 0)) for d in self.decls]
        return ir.Graph(self.name, nodes, list(self.endpoints), self.report, self.fallback)

    def lower(self, spark: SparkSession, external: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """A DataFrame for every channel. ``external`` gives tapped channels, and replaces sources of the same name.

        Channels with several producers are merged by arrival. A loop over named channels cannot be lowered
        column by column: declare it with ``FlowBuilder.fold``.
        """
        made: dict[str, DataFrame] = dict(external or {})
        waiting = [d for d in self.decls if d.kind != "sink" and d.output not in made]
        producers: dict[str, int] = {}
        for d in waiting:
            producers[d.output] = producers.get(d.output, 0) + 1
        parts: dict[str, list[DataFrame]] = {}
        while waiting:
            ready = [d for d in waiting if all(i in made for i in d.inputs)]
            if not ready:
                raise ValueError(f"nothing produces, or a loop feeds, the inputs of {[d.output for d in waiting]}")
            for d in ready:
                df = d.plan(d.output, *[made[i] for i in d.inputs] or [spark])
                if d.kind == "stateful":
                    df, made[d.state] = df
                parts.setdefault(d.output, []).append(df)
                if len(parts[d.output]) == producers[d.output]:
                    made[d.output] = parts[d.output][0] if producers[d.output] == 1 else _merged(d.output, parts[d.output])
            waiting = [d for d in waiting if d not in ready]
        return made

    def run(self, spark: SparkSession, external: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Lower the flow and hand every sink its channel."""
        made = self.lower(spark, external)
        for d in self.decls:
            if d.kind == "sink" and d.plan:
                d.plan(made[d.inputs[0]])
        return made


def _merged(channel: str, parts: list[DataFrame]) -> DataFrame:
    """The hop that each producer has given its own number gets the number in the merged channel."""
    cut = lambda b: F.struct(b["root"].alias("root"), F.slice(b["hops"], F.lit(1), F.size(b["hops"]) - 1).alias("hops"))
    return O.merge_into(channel, *[p.withColumn("lineage", F.transform("lineage", cut)) for p in parts])
