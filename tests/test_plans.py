import pytest
from pyspark.sql import functions as F

from weirflow.functions.scalars import fnv1a64, format_g, sanitize, split_list
from weirflow.plans import dagfile, ir, registry, sla
from weirflow.plans.flow import FlowBuilder


def nodes():
    return [sla.Node("map", ("s",), "m", 8000), sla.Node("map", ("m",), "e", 3000)]


def test_budgets_share_the_deadline():
    r = sla.plan({"s": 0}, nodes(), [("e", 50_000)])
    assert r.ok and r.budgets == {"e": 13636, "m": 36363}


def test_overrun_names_path_and_worst_node():
    v = sla.plan({"s": 0}, nodes(), [("e", 10_000)]).violations[0]
    assert (v.planned_us, v.path, v.worst) == (11_040, ("e", "m", "s"), "map -> m")


def test_endpoints_do_not_share_paths():
    r = sla.plan({"s": 0, "t": 0}, [*nodes(), sla.Node("map", ("t",), "f", 10)], [("e", 50_000), ("f", 100)])
    assert r.ok and r.budgets["f"] == 100


def test_cycles_count_once_and_defaults_are_noted():
    r = sla.plan({"s": 0}, [sla.Node("join", ("s", "b"), "j"), sla.Node("map", ("j",), "b", 50)], [("b", 1000)])
    assert r.ok and r.defaulted == ["join -> j"]


def test_saturation_warns_or_rejects():
    n = [sla.Node("map", ("s",), "m", 2000)]
    loose = sla.plan({"s": 1000}, n, [("m", 10_000)], sla.Config(cores=1))
    assert loose.ok and "warning" in loose.saturation
    assert not sla.plan({"s": 1000}, n, [("m", 10_000)], sla.Config(cores=1, strict=True)).ok
    with pytest.raises(ValueError, match="neither"):
        sla.plan({}, n, [("x", 1)])


def test_build_rejects_overrun(spark):
    f = FlowBuilder("f")
    f.source("s", lambda s: s.range(1)).map(v=F.lit(1)).with_wcet(8000).with_sla(100)
    with pytest.raises(sla.DeadlineError, match="f/~0"):
        f.build()


def test_hash_does_not_depend_on_order_of_declaration():
    a = ir.Graph("g", [ir.Node("source", (), "g/a"), ir.Node("source", (), "g/b"), ir.Node("map", ("g/a",), "g/~0"), ir.Node("map", ("g/b",), "g/~1"), ir.Node("join", ("g/~0", "g/~1"), "g/~2")])
    b = ir.Graph("g", [ir.Node("source", (), "g/b"), ir.Node("source", (), "g/a"), ir.Node("map", ("g/b",), "g/~0"), ir.Node("map", ("g/a",), "g/~1"), ir.Node("join", ("g/~1", "g/~0"), "g/~2")])
    assert a.stable_hash() == b.stable_hash()
    c = ir.Graph("g", [*a.nodes[:-1], ir.Node("join", ("g/~0", "g/~1"), "g/~2", wcet_us=5)])
    assert c.stable_hash() != a.stable_hash()


def test_cyclic_nodes_come_last():
    g = ir.Graph("g", [ir.Node("map", ("g/y",), "g/x"), ir.Node("map", ("g/x",), "g/y"), ir.Node("source", (), "g/s")]).ordered()
    assert [n.output for n in g.nodes] == ["g/s", "g/x", "g/y"]


def test_validation():
    ir.Graph("g", [ir.Node("map", ("g/in",), "g/x")]).validate({"g/in"})
    with pytest.raises(ValueError, match="nothing produces"):
        ir.Graph("g", [ir.Node("map", ("g/in",), "g/x")]).validate()
    with pytest.raises(ValueError, match="more than one"):
        ir.Graph("g", [ir.Node("source", (), "g/x"), ir.Node("source", (), "g/x")]).validate()


def test_exports(spark):
    f = FlowBuilder("f")
    f.source("s", lambda s: s.range(1)).map(v=F.lit(1)).with_wcet(10).with_sla(1000)
    g = f.build().graph()
    assert 'inputs = ["f/s"]\noutput = "f/~0"\ntype = "row"\nwcet_us = 10\n' in g.export_dag()
    assert "sla_ok = true" in g.export_conf() and "deadline_us = 1000" in g.export_conf() and "planned_us = 1000" in g.export_conf()


def test_dag_files():
    got = dagfile.parse("# c\n[component cam]\ntype = Camera\ninterval_ms=50\n\n[component fuse]\ntype=Fuse\ninputs = a, b,, c \n")
    assert [(c.name, c.type, c.inputs, c.interval_ms) for c in got] == [("cam", "Camera", [], 50), ("fuse", "Fuse", ["a", "b", "c"], 0)]
    for bad, why in [("[x]", "unrecognized"), ("[component ]", "name"), ("type=a", "outside"), ("[component a]\nfoo=1", "unknown key"), ("[component a]\ninterval_ms=-1", "bad interval"), ("[component a]", "missing type")]:
        with pytest.raises(ValueError, match=why):
            dagfile.parse(bad)


def test_registry():
    registry.component("two", 2)(lambda a, b: None)
    assert registry.get_component("two", 1) is None and registry.get_component("two", 2)
    with pytest.raises(KeyError):
        registry.build_flow("no such flow")


def test_components_check_their_inputs(spark):
    registry.component("needs_v", 1, ["v long"])(lambda d: d)
    rows = lambda kind: (lambda s: s.range(3).select(F.col("id").alias("ts_ns"), F.lit(1).cast(kind).alias("v")))
    for kind, fits in (("long", True), ("string", False)):
        f = FlowBuilder("f")
        f.from_("needs_v", f.source("s", rows(kind)))
        if fits:
            assert f.build().lower(spark)["f/~0"].count() == 3
        else:
            with pytest.raises(ValueError, match="needs v bigint, which is string"):
                f.build().lower(spark)


def test_periodic_sources(spark):
    f = FlowBuilder("f")
    f.source("t", interval_us=50, ticks=4)
    assert [(r.seq, r.ts_ns) for r in f.build().lower(spark)["f/t"].orderBy("seq").collect()] == [(k, k * 50_000) for k in range(4)]


def test_planner_on_many_diamonds_and_long_chains():
    chain, last = [], "s"
    for k in range(400):  # 2 ** 400 ways, found one by one
        chain += [sla.Node("map", (last,), f"a{k}", 2), sla.Node("map", (last,), f"b{k}", 1), sla.Node("join", (f"a{k}", f"b{k}"), f"c{k}", 1)]
        last = f"c{k}"
    r = sla.plan({"s": 0}, chain, [(last, 1)])
    assert r.violations[0].planned_us == 400 * (2 + 1 + 2 * 20) and r.violations[0].path[-1] == "s"


def test_dag_files_name_the_line():
    with pytest.raises(ValueError, match="line 3: unknown key 'x'"):
        dagfile.parse("[component a]\ntype = T\nx = 1")


def test_scalars(spark):
    assert fnv1a64("") == 0xCBF29CE484222325 and fnv1a64("a") == 0xAF63DC4C8601EC8C
    assert sanitize("a/b-c") == "a_b_c"
    df = spark.createDataFrame([(3.5, "a, b,,"), (None, ""), (1e-7, "x"), (1234567.0, " y ")], "v double, s string")
    rows = df.select(format_g("v").alias("g"), split_list(F.col("s")).alias("l")).collect()
    assert [r.g for r in rows] == ["3.5", None, "1e-07", "1.23457e+06"] and [r.l for r in rows] == [["a", "b"], [], ["x"], ["y"]]
