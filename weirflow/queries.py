"""Registered queries over the driver's tables, each beside its SQL.

``events`` is the message log of a flow: an event type is a channel, time and id give
the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import lineage as L
from weirflow.operators import dataflow as O
from weirflow.operators import records as R
from weirflow.operators import timing as T
from weirflow.operators.numbering import number
from weirflow.plans import dagfile, ir, registry, sla
from weirflow.plans.flow import FlowBuilder
from weirflow.shared import fresh_path, written
from weirflow.sources import trec
from weirflow.streaming import twins

HOUR = 3_600_000_000_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = WITH + sql
        return fn

    return put


#: Events in order: c has one row an event, with its number in its channel and on arrival.
WITH = """with e as (select event_id, user_id, event_type, epoch_us(ts) * 1000 as ts_ns, cast(round(value * 100) as bigint) as cents, props from events),
c as (select *, row_number() over (partition by event_type order by ts_ns, event_id) - 1 as seq, row_number() over (order by ts_ns, event_id) - 1 as arrival from e)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select("event_id", "user_id", "event_type", (us * 1000).alias("ts_ns"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), "props")


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number(events(spark, sf_dir), ["ts_ns", "event_id"], "arrival")


def channels(spark: SparkSession, sf_dir: str, *kinds: str) -> dict[str, DataFrame]:
    """Channels of one flow: all events are numbered once on arrival, and each kind by its own order."""
    rows = arrived(spark, sf_dir).drop("props")
    return {k: O.source(rows.filter(F.col("event_type") == k).drop("event_type"), f"flow/{k}", ["arrival"]) for k in kinds}


def channel(spark: SparkSession, sf_dir: str, kind: str, all_arrivals: bool = True) -> DataFrame:
    if all_arrivals:
        return channels(spark, sf_dir, kind)[kind]
    rows = events(spark, sf_dir).filter(F.col("event_type") == kind).drop("event_type", "props")
    return O.source(rows, f"flow/{kind}", ["ts_ns", "event_id"]).withColumn("arrival", F.col("seq"))


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, L.describe("lineage").alias("lineage"))


def click_flow() -> FlowBuilder:
    f = FlowBuilder("flow")
    f.tap("click").map(double_cents=F.col("cents") * 2)
    return f


@query("select seq, cents * 2 as double_cents, 'flow/click#' || seq || ' -> flow/~0#' || seq as lineage from c where event_type = 'click'")
def source_map(spark, sf_dir):
    made = click_flow().build().lower(spark, {"flow/click": channel(spark, sf_dir, "click", all_arrivals=False)})
    return text(made["flow/~0"], "seq", "double_cents")


@query("""select row_number() over (order by arrival) - 1 as seq, event_id, cents,
    'flow/' || event_type || '#' || seq || ' -> flow/merged#' || (row_number() over (order by arrival) - 1) as lineage
    from c where event_type in ('click', 'view')""")
def map_to_union(spark, sf_dir):
    f = FlowBuilder("flow")
    for kind in ("click", "view"):
        f.tap(kind).map_to("merged", event_id=F.col("event_id"), cents=F.col("cents"))
    given = {f"flow/{k}": v for k, v in channels(spark, sf_dir, "click", "view").items()}
    return text(f.build().lower(spark, given)["flow/merged"], "seq", "event_id", "cents")


@query("""select row_number() over (order by seq) - 1 as seq, event_id,
    'flow/error#' || seq || ' -> flow/~0#' || (row_number() over (order by seq) - 1) as lineage
    from c where event_type = 'error' and cents > 1000""")
def op_filter(spark, sf_dir):
    f = FlowBuilder("flow")
    row = F.array(F.struct("event_id"))
    f.tap("error").op(F.when(F.col("cents") > 1000, row).otherwise(F.slice(row, 1, 0)))
    return text(f.build().lower(spark, {"flow/error": channel(spark, sf_dir, "error", all_arrivals=False)})["flow/~0"], "seq", "event_id")


@query("""select row_number() over (order by seq, part) - 1 as seq, event_id, part,
    'flow/purchase#' || seq || ' -> flow/~0#' || (row_number() over (order by seq, part) - 1) as lineage
    from (select *, unnest(range(event_id % 3)) as part from c where event_type = 'purchase')""")
def op_flatmap(spark, sf_dir):
    f = FlowBuilder("flow")
    n = F.col("event_id") % 3
    parts = F.slice(F.array(*[F.struct("event_id", F.lit(k).cast("bigint").alias("part")) for k in range(3)]), F.lit(1), n.cast("int"))
    f.tap("purchase").op(parts)
    given = {"flow/purchase": channel(spark, sf_dir, "purchase", all_arrivals=False)}
    return text(f.build().lower(spark, given)["flow/~0"], "seq", "event_id", "part")


@query("""select 0 as seq, -1 as cents, 'flow/~0#0' as lineage
    union all select seq + 1, cents * 2, 'flow/signup#' || seq || ' -> flow/~0#' || (seq + 1) from c where event_type = 'signup'""")
def op_init_bootstrap(spark, sf_dir):
    f = FlowBuilder("flow")
    f.tap("signup").op(F.array(F.struct((F.col("cents") * 2).alias("cents"))), init=F.array(F.struct(F.lit(-1).cast("bigint").alias("cents"))))
    return text(f.build().lower(spark, {"flow/signup": channel(spark, sf_dir, "signup", all_arrivals=False)})["flow/~0"], "seq", "cents")


@query("""select k as branch, seq, cents * k as scaled, 'flow/view#' || seq || ' -> flow/~' || (k - 1) || '#' || seq as lineage
    from c, (select unnest([1, 2, 3, 4]) as k) where event_type = 'view'""")
def fanout_four(spark, sf_dir):
    f = FlowBuilder("flow")
    view = f.tap("view")
    for k in range(1, 5):
        view.map(branch=F.lit(k), scaled=F.col("cents") * k)
    made = f.build().lower(spark, {"flow/view": channel(spark, sf_dir, "view", all_arrivals=False)})
    a, b, c, d = (text(made[f"flow/~{k}"], "branch", "seq", "scaled") for k in range(4))
    return a.unionByName(b).unionByName(c).unionByName(d)


def pair_flow():
    f = FlowBuilder("flow")
    f.join(f.tap("click"), f.tap("view"), lambda a, b: {"a_id": a("event_id"), "b_id": b("event_id"), "cents": a("cents") + b("cents")})
    return f


@query("""select a.seq, a.event_id as a_id, b.event_id as b_id, a.cents + b.cents as cents
    from c a join c b on a.seq = b.seq where a.event_type = 'click' and b.event_type = 'view'""")
def join_zip(spark, sf_dir):
    given = {f"flow/{k}": channel(spark, sf_dir, k, all_arrivals=False) for k in ("click", "view")}
    return pair_flow().build().lower(spark, given)["flow/~0"].select("seq", "a_id", "b_id", "cents")


@query("""select a.seq, 'flow/click#' || a.seq || ' -> flow/~0#' || a.seq || ' | flow/view#' || a.seq || ' -> flow/~0#' || a.seq as lineage
    from c a join c b on a.seq = b.seq where a.event_type = 'click' and b.event_type = 'view'""")
def join_zip_lineage(spark, sf_dir):
    given = {f"flow/{k}": channel(spark, sf_dir, k, all_arrivals=False) for k in ("click", "view")}
    return text(pair_flow().build().lower(spark, given)["flow/~0"], "seq")


@query("""select a.seq, a.cents + b.cents + d.cents as cents, 'flow/click#' || a.seq || ' -> flow/~0#' || a.seq || ' -> flow/~1#' || a.seq
    || ' | flow/view#' || a.seq || ' -> flow/~0#' || a.seq || ' -> flow/~1#' || a.seq || ' | flow/error#' || a.seq || ' -> flow/~1#' || a.seq as lineage
    from c a join c b on a.seq = b.seq join c d on a.seq = d.seq where a.event_type = 'click' and b.event_type = 'view' and d.event_type = 'error'""")
def join3_fanin(spark, sf_dir):
    f = pair_flow()
    f.join(f.tap("~0"), f.tap("error"), lambda a, b: {"cents": a("cents") + b("cents")})
    given = {f"flow/{k}": channel(spark, sf_dir, k, all_arrivals=False) for k in ("click", "view", "error")}
    return text(f.build().lower(spark, given)["flow/~1"], "seq", "cents")


@query("""select user_id, row_number() over (partition by user_id order by a) - 1 as pair, a, b from (
    select x.user_id, x.n as a, y.n as b from (select user_id, row_number() over (partition by user_id order by ts_ns, event_id) - 1 as n from e where event_type = 'click') x
    join (select user_id, row_number() over (partition by user_id order by ts_ns, event_id) - 1 as n from e where event_type = 'view') y on x.user_id = y.user_id and x.n = y.n)""")
def join_zip_by_key(spark, sf_dir):
    """The queue form, deep enough that nothing is dropped, which must give the exact zip."""
    rows = events(spark, sf_dir).filter("event_type in ('click', 'view')").withColumn("side", F.when(F.col("event_type") == "click", 0).otherwise(1))
    return O.zip_with_queues(rows, ["user_id"], "side", ["ts_ns", "event_id"], depth=1 << 30)


#: The queues message by message: s is how far clicks are ahead of views, at most ``depth`` either way.
DROPS = """, u as (select {key} as k, case when event_type = 'click' then 0 else 1 end as side, row_number() over (partition by {key} order by ts_ns, event_id) as n from e where event_type in ('click', 'view')),
l as (select k, list(side order by n) as v from u group by k),
r as (select k, v, 0 as n, cast(0 as bigint) as s, cast(0 as bigint) as c0, cast(0 as bigint) as c1, cast(null as bigint) as a, cast(null as bigint) as b from l
    union all select k, v, n + 1, greatest(-{depth}, least({depth}, s + 1 - 2 * v[n + 1])), c0 + 1 - v[n + 1], c1 + v[n + 1],
    case when v[n + 1] = 0 and s < 0 then c0 when v[n + 1] = 1 and s > 0 then c0 - s end, case when v[n + 1] = 0 and s < 0 then c1 + s when v[n + 1] = 1 and s > 0 then c1 end
    from r where n < len(v)),
p as (select k, row_number() over (partition by k order by n) - 1 as pair, a, b from r where a is not null)
"""


def recursive(fn):
    ORACLES[fn.__name__] = ORACLES[fn.__name__].replace("with e as", "with recursive e as", 1)
    return fn


@recursive
@query(DROPS.format(key="user_id", depth=1) + "select k as user_id, pair, a, b from p")
def join_zip_overflow(spark, sf_dir):
    """Queues of depth 1 that drop their oldest message, one instance a user."""
    rows = events(spark, sf_dir).filter("event_type in ('click', 'view')").withColumn("side", F.when(F.col("event_type") == "click", 0).otherwise(1))
    return O.zip_with_queues(rows, ["user_id"], "side", ["ts_ns", "event_id"], depth=1)


@recursive
@query(DROPS.format(key="0", depth=16) + """select pair as seq, x.cents + y.cents as cents, 'flow/click#' || p.a || ' -> flow/~0#' || pair || ' | flow/view#' || p.b || ' -> flow/~0#' || pair as lineage
    from p join (select * from c where event_type = 'click') x on p.a = x.seq join (select * from c where event_type = 'view') y on p.b = y.seq""")
def flow_join_dropping(spark, sf_dir):
    """A join of a flow whose queues hold 16 messages: payload and lineage of the pairs that are left."""
    f = FlowBuilder("flow")
    f.join(f.tap("click"), f.tap("view"), lambda a, b: {"cents": a("cents") + b("cents")}, depth=O.QUEUE)
    given = {f"flow/{k}": v for k, v in channels(spark, sf_dir, "click", "view").items()}
    return text(f.build().lower(spark, given)["flow/~0"], "seq", "cents")


@query("""select a.seq, a.cents + b.cents + d.cents + g.cents as cents, 'flow/click#' || a.seq || ' -> flow/~0#' || a.seq || ' | flow/view#' || a.seq || ' -> flow/~0#' || a.seq
    || ' | flow/error#' || a.seq || ' -> flow/~0#' || a.seq || ' | flow/purchase#' || a.seq || ' -> flow/~0#' || a.seq as lineage
    from c a join c b on a.seq = b.seq join c d on a.seq = d.seq join c g on a.seq = g.seq
    where a.event_type = 'click' and b.event_type = 'view' and d.event_type = 'error' and g.event_type = 'purchase'""")
def fusion_four(spark, sf_dir):
    f = FlowBuilder("flow")
    kinds = ("click", "view", "error", "purchase")
    f.fuse([f.tap(k) for k in kinds], lambda *p: {"cents": p[0]("cents") + p[1]("cents") + p[2]("cents") + p[3]("cents")})
    return text(f.build().lower(spark, {f"flow/{k}": channel(spark, sf_dir, k, all_arrivals=False) for k in kinds})["flow/~0"], "seq", "cents")


def spans(spark, sf_dir, lo, hi, width, history=None, folds=None):
    f = FlowBuilder("flow")
    f.span_join(f.tap("error"), f.tap("click"), (F.col("ts_ns") + lo, F.col("ts_ns") + hi), width, history=history, folds=folds)
    kinds = ("error", "click")
    found = {k: channel(spark, sf_dir, k, all_arrivals=False) for k in kinds} if history is None else channels(spark, sf_dir, *kinds)
    given = {f"flow/{k}": v for k, v in found.items()}
    return f.build().lower(spark, given)["flow/~0"]


SPAN = """, s as (select t.seq, count(d.seq) as n, coalesce(sum(d.cents), 0) as cents, min(d.seq) as lo, max(d.seq) as hi
    from (select * from c where event_type = 'error') t left join (select * from c where event_type = 'click') d on d.ts_ns between t.ts_ns + {} and t.ts_ns + {} group by t.seq)
"""
SPAN_TEXT = """select seq, n, 'flow/error#' || seq || ' -> flow/~0#' || seq || case when n = 0 then '' else
    ' | flow/click#' || lo || case when hi > lo then '..#' || hi else '' end || ' -> flow/~0#' || seq end as lineage from s"""


@query(SPAN.format(-6 * HOUR, 0) + "select seq, n, cast(cents as bigint) as cents from s")
def span_join_count(spark, sf_dir):
    f = FlowBuilder("flow")
    f.span_aggregate(f.tap("error"), f.tap("click"), (F.col("ts_ns") - 6 * HOUR, F.col("ts_ns")), 6 * HOUR, {"cents": F.sum("cents")})
    given = {f"flow/{k}": channel(spark, sf_dir, k, all_arrivals=False) for k in ("error", "click")}
    return f.build().lower(spark, given)["flow/~0"].select("seq", "n", F.coalesce("cents", F.lit(0)).alias("cents"))


@query(SPAN.format(-6 * HOUR, 0) + "select seq, n, cast(cents as bigint) as cents, cast(n * 1000 + coalesce(hi - lo, 0) as bigint) as spread from s")
def span_join_items(spark, sf_dir):
    """The slices themselves, reduced in the tasks that cut them."""
    s = spans(spark, sf_dir, -6 * HOUR, 0, 6 * HOUR, folds={"cents": ("sum", "cents")})
    spread = F.col("n") * 1000 + F.coalesce(F.col("seq_hi") - F.col("seq_lo"), F.lit(0))
    return s.select("seq", "n", F.coalesce("cents", F.lit(0)).alias("cents"), spread.alias("spread"))


@query(SPAN.format(-6 * HOUR, 0) + SPAN_TEXT)
def span_join_lineage(spark, sf_dir):
    return text(spans(spark, sf_dir, -6 * HOUR, 0, 6 * HOUR, folds={}), "seq", "n")


@query(SPAN.format(HOUR // 36, HOUR // 18) + SPAN_TEXT)
def span_join_empty(spark, sf_dir):
    s = spans(spark, sf_dir, HOUR // 36, HOUR // 18, HOUR // 36)
    return text(s.withColumn("n", F.size("items").cast("bigint")), "seq", "n")


@query(f"""select t.seq, count(d.seq) as n, coalesce(min(d.seq), -1) as lo, coalesce(max(d.seq), -1) as hi,
    coalesce(min(k.seq) > 0 and arg_min(k.ts_ns, k.seq) > t.ts_ns - {48 * HOUR}, false) as truncated
    from (select * from (select *, count(*) filter (event_type = 'click') over (order by arrival) as before from c) where event_type = 'error') t
    left join (select * from c where event_type = 'click') k on k.seq between t.before - 64 and t.before - 1
    left join (select * from c where event_type = 'click') d on d.seq = k.seq and d.ts_ns between t.ts_ns - {48 * HOUR} and t.ts_ns
    group by t.seq, t.ts_ns""")
def span_join_bounded64(spark, sf_dir):
    s = spans(spark, sf_dir, -48 * HOUR, 0, 48 * HOUR, history=O.HISTORY)
    return s.select("seq", F.size("items").cast("bigint").alias("n"), F.coalesce("seq_lo", F.lit(-1)).alias("lo"), F.coalesce("seq_hi", F.lit(-1)).alias("hi"), "truncated")


FOLDS = {"n": ("sum", "one"), "total": ("sum", "cents"), "least": ("min", "cents"), "most": ("max", "cents")}


def folded(spark, sf_dir):
    rows = channel(spark, sf_dir, "purchase", all_arrivals=False).withColumn("one", F.lit(1).cast("bigint"))
    f = FlowBuilder("flow")
    f.stateful(f.tap("purchase"), "out", "acc", FOLDS, {"n": F.col("n"), "mean_cents": F.col("total") / F.col("n")})
    return rows, f.build().lower(spark, {"flow/purchase": rows})


@query("select seq, seq + 1 as n, sum(cents) over (order by seq) / (seq + 1) as mean_cents from c where event_type = 'purchase'")
def stateful_running_fold(spark, sf_dir):
    return folded(spark, sf_dir)[1]["flow/out"].select("seq", "n", "mean_cents")


@query("""select seq, seq + 1 as n, cast(sum(cents) over w as bigint) as total, min(cents) over w as least, max(cents) over w as most,
    'flow/purchase#' || seq || ' -> flow/acc#' || seq as lineage from c where event_type = 'purchase' window w as (order by seq)""")
def state_versions_lineage(spark, sf_dir):
    return text(folded(spark, sf_dir)[1]["flow/acc"], "seq", "n", "total", "least", "most")


@query("""select 59 as absorbed, count(*) - 60 as replayed, count(*) as n, cast(sum(cents) as bigint) as total, min(cents) as least, max(cents) as most
    from c where event_type = 'purchase'""")
def recovery_suffix(spark, sf_dir):
    rows, made = folded(spark, sf_dir)
    return O.recover(rows, made["flow/acc"], 59, FOLDS)


LOOP = 1009


def loop_step(state, row):
    state = (3 * state + int(row.cents)) % LOOP
    return state, [(int(row.n), state)]


def plan_step(state, row):
    state = (3 * state + row.cents) % LOOP
    return state, [(state,)]


LOOP_SQL = f""", u as (select user_id, cents, row_number() over (partition by user_id order by ts_ns, event_id) - 1 as n from e where event_type = 'view'),
l as (select user_id, list(cents order by n) as v from u group by user_id),
r as (select user_id, v, 0 as n, v[1] % {LOOP} as state from l union all select user_id, v, n + 1, (3 * state + v[n + 2]) % {LOOP} from r where n + 2 <= len(v))
select user_id, n, state from r"""


@recursive
@query(LOOP_SQL)
def feedback_loop(spark, sf_dir):
    """The plan of one message feeds the next: a cycle, folded per user."""
    rows = number(events(spark, sf_dir).filter("event_type = 'view'"), ["ts_ns", "event_id"], "n", by=["user_id"])
    return O.fold_by_key(rows, ["user_id"], ["n"], lambda: 0, loop_step, "user_id long, n long, state long")


@recursive
@query(""", l as (select list(cents order by seq) as v from c where event_type = 'view'),
r as (select v, 0 as n, v[1] % {LOOP} as state from l union all select v, n + 1, (3 * state + v[n + 2]) % {LOOP} from r where n + 2 <= len(v))
select cast(n as bigint) as seq, cast(state as bigint) as state, 'flow/view#' || n || ' -> flow/plan#' || n as lineage from r""".replace("{LOOP}", str(LOOP)))
def flow_feedback(spark, sf_dir):
    """A loop in a flow: each plan depends on the one before, over the whole channel."""
    f = FlowBuilder("flow")
    f.fold(f.tap("view"), "plan", lambda: 0, plan_step, "state long")
    return text(f.build().lower(spark, {"flow/view": channel(spark, sf_dir, "view", all_arrivals=False)})["flow/plan"], "seq", "state")


@query("""select seq, event_id, 'flow/click#' || seq as lineage from c where event_type = 'click' qualify row_number() over (order by seq desc) <= 64""")
def history_last64(spark, sf_dir):
    return text(O.history(channel(spark, sf_dir, "click", all_arrivals=False)), "seq", "event_id")


@query("select event_type, arg_max(event_id, arrival) as event_id, max(arrival) as arrival, max(seq) as seq from c group by event_type")
def latest_value(spark, sf_dir):
    rows = number(arrived(spark, sf_dir), ["arrival"], by=["event_type"])
    return O.latest(rows.select("event_type", "event_id", "arrival", "seq"), ["event_type"])


def log(spark, sf_dir) -> DataFrame:
    """All events as a record: the properties are the payload."""
    rows = number(arrived(spark, sf_dir), ["arrival"], by=["event_type"])
    lineage = F.array(F.struct(F.struct(F.col("event_type").alias("channel"), "seq", F.col("seq").alias("seq_end")).alias("root"), F.array().cast(f"array<{L.HOP}>").alias("hops")))
    return rows.select(F.col("event_type").alias("channel"), "seq", "ts_ns", "arrival", F.col("props").cast("binary").alias("payload"), lineage.alias("lineage"))


@query("""select event_type as channel, count(*) as n, cast(sum(strlen(props)) as bigint) as n_bytes, min(seq) as first_seq, max(seq) as last_seq, min(ts_ns) as first_ts_ns,
    max(ts_ns) as last_ts_ns, case when max(ts_ns) > min(ts_ns) then count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9) else 0.0 end as rate_hz from c group by event_type""")
def record_stats(spark, sf_dir):
    return R.channel_stats(log(spark, sf_dir))


@query("""select event_type as channel, case when max(ts_ns) > min(ts_ns) then count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9) else 0.0 end as rate_hz from c group by event_type""")
def record_rate(spark, sf_dir):
    return R.channel_stats(log(spark, sf_dir)).select("channel", "rate_hz")


@query("select count(*) as n, cast(sum(strlen(props)) as bigint) as n_bytes, max(ts_ns) - min(ts_ns) as duration_ns from c")
def record_totals(spark, sf_dir):
    return R.totals(log(spark, sf_dir))


DAY10 = 1_704_067_200_000_000_000 + 9 * 24 * HOUR


@query(f"select seq, ts_ns, props as payload from c where event_type = 'view' and ts_ns between {DAY10} and {DAY10 + 24 * HOUR}")
def record_range(spark, sf_dir):
    path = fresh_path(spark, "record")
    R.write(log(spark, sf_dir), path)
    return R.read_range(R.read(spark, path), "view", DAY10, DAY10 + 24 * HOUR).select("seq", "ts_ns", F.col("payload").cast("string").alias("payload"))


@query(f"select event_type as channel, seq, ts_ns from c where ts_ns between {DAY10} and {DAY10 + 24 * HOUR}")
def record_split(spark, sf_dir):
    return R.split_by_time(log(spark, sf_dir), DAY10, DAY10 + 24 * HOUR).select("channel", "seq", "ts_ns")


@query("""select row_number() over (order by ts_ns, arrival) - 1 as place, event_type as channel, seq from c where event_type in ('click', 'error')""")
def record_merge(spark, sf_dir):
    rows = log(spark, sf_dir)
    both = R.merge(*[rows.filter(F.col("channel") == k) for k in ("click", "error")])
    return number(both, ["ts_ns", "arrival"], "place").select("place", "channel", "seq")


@query("select event_type as channel, seq, ts_ns from c where seq < 5")
def record_first_n(spark, sf_dir):
    return R.first_n(log(spark, sf_dir), 5).select("channel", "seq", "ts_ns")


@query(f"select event_type as channel, seq, ts_ns from c where ts_ns >= {DAY10} order by ts_ns, arrival limit 1")
def record_seek(spark, sf_dir):
    return R.seek(log(spark, sf_dir), DAY10).select("channel", "seq", "ts_ns")


@query("select event_type as channel, seq from c qualify row_number() over (partition by event_type order by arrival desc) <= 64")
def record_dump(spark, sf_dir):
    return R.dump(log(spark, sf_dir)).select("channel", "seq")


@query("select seq, strlen(props) * 2 as size, 'click#' || seq || ' -> flow/~0#' || seq as lineage from c where event_type = 'click'")
def replay_equivalence(spark, sf_dir):
    """A recorded source, written, read and replayed through a flow, gives what the live source gave."""
    path = fresh_path(spark, "record")
    R.write(log(spark, sf_dir), path)
    f = FlowBuilder("flow")
    f.tap("click").map(size=(F.octet_length("payload") * 2).cast("bigint"))
    return text(f.build().lower(spark, {"flow/click": R.replay(R.read(spark, path), ["click"])["click"]})["flow/~0"], "seq", "size")


@query("select event_type as channel, seq, ts_ns, arrival, props as payload, event_type || '#' || seq as lineage from c")
def record_file(spark, sf_dir):
    """The binary record format: written by its sink and read back by its source, checksums verified."""
    path = fresh_path(spark, "trec")
    trec.write(log(spark, sf_dir), path)
    back = number(trec.read(spark, path).withColumnRenamed("arrival", "_came"), ["_came"], "arrival")
    return back.select("channel", "seq", "ts_ns", "arrival", F.col("payload").cast("string").alias("payload"), L.describe("lineage").alias("lineage"))


@query(f"select event_type as channel, seq, ts_ns from c where event_type in ('error', 'signup') and ts_ns between {DAY10} and {DAY10 + 24 * HOUR}")
def record_file_range(spark, sf_dir):
    """Two channels and a day of a record in files; chunks without them are passed over."""
    path = fresh_path(spark, "trec")
    trec.write(log(spark, sf_dir), path)
    return trec.read(spark, path, ["error", "signup"], DAY10, DAY10 + 24 * HOUR).select("channel", "seq", "ts_ns")


@query(f"select event_type as channel, seq, ts_ns from c where ts_ns >= {DAY10} order by ts_ns, arrival limit 1")
def record_file_seek(spark, sf_dir):
    path = fresh_path(spark, "trec")
    trec.write(log(spark, sf_dir), path)
    return trec.seek(spark, path, DAY10).select("channel", "seq", "ts_ns")


def staged(spark, sf_dir) -> DataFrame:
    """A record of clicks, their mapped form some time later, and its join with views."""
    click, view = channels(spark, sf_dir, "click", "view").values()
    f = FlowBuilder("flow")
    mapped = f.tap("click").map(event_id=F.col("event_id"))
    f.join(mapped, f.tap("view"), lambda a, b: {"event_id": a("event_id"), "other": b("event_id")})
    made = f.build().lower(spark, {"flow/click": click, "flow/view": view})
    delay = F.col("event_id") % 50 * 1000 + 1000
    late = {
        "flow/click": click,
        "flow/view": view,
        "flow/~0": made["flow/~0"].withColumn("ts_ns", F.col("ts_ns") + delay),
        "flow/~1": made["flow/~1"].withColumn("ts_ns", F.col("ts_ns") + delay * 3),
    }
    rows = R.record({k: v.withColumn("payload", F.lit("")) for k, v in late.items()})
    place = F.create_map(*[F.lit(x) for i, k in enumerate(late) for x in (k, i)])[F.col("channel")]
    # a derived message is recorded after the one that made it; written once: calibration reads it as inputs and as outputs
    return written(rows.withColumn("arrival", F.col("arrival") * 4 + place), "staged")


STAGED = """, k as (select a.seq, a.ts_ns as in_ns, b.ts_ns as b_ns, a.event_id % 50 * 1000 + 1000 as d, b.seq is not null as paired from (select * from c where event_type = 'click') a
    left join (select * from c where event_type = 'view') b on a.seq = b.seq),
l as (select 'flow/~0' as stage, d as x from k union all select 'flow/~1', greatest(in_ns, b_ns) + 3 * d - in_ns - d from k where paired),
s as (select stage, x, row_number() over (partition by stage order by x) - 1 as place, count(*) over (partition by stage) as n from l where x >= 0),
cal as (select stage, n, max(x) filter (place = least(n - 1, floor(0.5 * n))) / 1000.0 as p50_us, max(x) filter (place = least(n - 1, floor(0.99 * n))) / 1000.0 as p99_us,
    max(x) filter (place = least(n - 1, floor(0.999 * n))) / 1000.0 as p999_us from s group by stage, n)
"""


@query(STAGED + "select stage, n, cast(p50_us as double) as p50_us, cast(p99_us as double) as p99_us, cast(p999_us as double) as p999_us, round(cast(p999_us as double) * 1.3, 6) as suggest_us from cal")
def calibrate_pct(spark, sf_dir):
    return T.calibrate(staged(spark, sf_dir)).withColumn("suggest_us", F.round("suggest_us", 6))


@query(STAGED + """, d as (select unnest(['flow/~0', 'flow/~1', 'flow/gone']) as stage, unnest([1000.0, 1.0, 1.0]) as declared_us)
    select d.stage, cast(d.declared_us as double) as declared_us, case when cal.stage is null then 'UNKNOWN' when declared_us > 3 * p999_us * 1.3 then 'HIGH' when 3 * declared_us < p999_us * 1.3 then 'LOW' else 'OK' end as verdict
    from d left join cal on d.stage = cal.stage""")
def calibrate_drift(spark, sf_dir):
    declared = spark.sql("select * from values ('flow/~0', 1000.0D), ('flow/~1', 1.0D), ('flow/gone', 1.0D) as t(stage, declared_us)")
    return T.drift(T.calibrate(staged(spark, sf_dir)), declared).drop("suggest_us")


#: End-to-end latencies in µs: the cents of an event, spread over the decades; the deadline is 4 ms.
E2E = "cents * power(10, event_id % 4)"
FLOOR = "case when us < 100 then 0 when us < 1000 then 100 when us < 10000 then 1000 when us < 100000 then 10000 when us < 1000000 then 100000 when us < 10000000 then 1000000 when us < 100000000 then 10000000 else 100000000 end"
LAT = f", q as (select event_type, ts_ns, cast({E2E} as bigint) as us from e), h as (select event_type, {FLOOR} as floor_us, count(*) as n from q group by all)\n"


def latencies(spark, sf_dir):
    return events(spark, sf_dir).select("event_type", "ts_ns", F.expr(f"cast({E2E} as bigint)").alias("us"), F.lit(4000).alias("deadline_us"))


@query(LAT + "select event_type, cast(floor_us as bigint) as floor_us, n from h")
def sla_histogram(spark, sf_dir):
    return T.histogram(latencies(spark, sf_dir), "event_type", "us")


@query(LAT + "select event_type, count(*) as n, count(*) filter (us > 4000) as misses from q group by event_type")
def sla_misses(spark, sf_dir):
    return T.misses(latencies(spark, sf_dir), "event_type", "us", "deadline_us")


@query(LAT + """, g as (select *, sum(n) over (partition by event_type order by floor_us) as upto, sum(n) over (partition by event_type) as total from h)
    select event_type, cast(min(floor_us) filter (upto >= round(total * 0.5)) as bigint) as p50_us, cast(min(floor_us) filter (upto >= round(total * 0.99)) as bigint) as p99_us from g group by event_type""")
def sla_bucket_pct(spark, sf_dir):
    return T.bucket_percentiles(T.histogram(latencies(spark, sf_dir), "event_type", "us"), "event_type", {"p50_us": 0.5, "p99_us": 0.99})


@query(LAT + """select event_type, ts_ns // 20000000 * 20000000 as window_ns, count(*) filter (us > 4000) as misses from q group by all having count(*) filter (us > 4000) >= 1""")
def degradation_windows(spark, sf_dir):
    return T.degradations(latencies(spark, sf_dir), "event_type", "ts_ns", F.col("us") > F.col("deadline_us"))


@query("""select event_id, hz, least(hz, 128) as shown_hz from (select event_id, count(*) over (partition by event_type order by fast_ns range between 1000000000 preceding and current row) as hz
    from (select *, ts_ns // 40000 as fast_ns from e))""")
def monitor_hz(spark, sf_dir):
    """Channel rates, on a clock 40,000 times faster so that channels reach hundreds a second."""
    fast = events(spark, sf_dir).withColumn("ts_ns", F.floor(F.col("ts_ns") / 40_000).cast("bigint"))
    return T.rate_hz(fast, "event_type").select("event_id", "hz", "shown_hz")


@query("select event_type as channel, count(*) as n, max(seq) as last_seq, arg_max(strlen(props), arrival) as last_size from c group by event_type")
def monitor_channels(spark, sf_dir):
    return T.monitor(log(spark, sf_dir))


@query("""select channel, "at", "by", greatest(lo, least("at" + "by", hi)) as lands_on from (select event_type as channel, max(seq) - 63 as lo, max(seq) as hi, max(seq) - 10 as "at" from c group by event_type),
    (select unnest([-100, -3, 5, 100]) as "by")""")
def monitor_cursor(spark, sf_dir):
    kept = written(R.dump(log(spark, sf_dir)).select("channel", "seq"), "kept")
    steps = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (-100, -3, 5, 100)]))
    moves = kept.groupBy("channel").agg((F.max("seq") - 10).alias("at")).select("channel", "at", steps.alias("by"))
    return T.cursor(kept, moves)


@query("select seq, 'a#' || seq || ' -> x#' || seq || ' -> j#' || seq || ' | b#' || (seq + 4) || '..#' || (seq + 9) || ' -> j#' || seq as lineage from c where event_type = 'click'")
def lineage_merge(spark, sf_dir):
    """The longer of two branches with one root channel stays, a new one is appended."""
    c = channel(spark, sf_dir, "click", all_arrivals=False)
    a = L.add_hop(L.rooted("a", "seq"), "x", "seq")
    b = L.rooted("b", F.col("seq") + 4, F.col("seq") + 9)
    both = L.merge(L.merge(a, L.rooted("a", F.col("seq") + 100)), b)
    return c.select("seq", L.describe(L.add_hop(both, "j", "seq")).alias("lineage"))


@query("""select a.seq as seq, branch, step, channel, a.seq as hop_seq from (select seq from c where event_type = 'click' intersect select seq from c where event_type = 'view') a,
    (select unnest([0, 0, 0, 1, 1]) as branch, unnest([0, 1, 2, 0, 1]) as step, unnest(['flow/click', 'flow/~0', 'flow/~1', 'flow/view', 'flow/~1']) as channel)""")
def lineage_trace(spark, sf_dir):
    f = FlowBuilder("flow")
    mapped = f.tap("click").map(event_id=F.col("event_id"))
    f.join(mapped, f.tap("view"), lambda a, b: {"event_id": a("event_id")})
    given = {f"flow/{k}": channel(spark, sf_dir, k, all_arrivals=False) for k in ("click", "view")}
    rows = f.build().lower(spark, given)["flow/~1"].select(F.col("seq").alias("own"), "lineage")
    return L.trace(rows).select(F.col("own").alias("seq"), "branch", "step", "channel", F.col("seq").alias("hop_seq"))


@registry.component("scale_cents", 1)
def scale_cents(df: DataFrame) -> DataFrame:
    return df.filter("cents % 2 = 0").select("seq", "arrival", "ts_ns", "lineage", (F.col("cents") * 10).alias("scaled"))


@query("""select row_number() over (order by seq) - 1 as seq, cents * 10 as scaled, 'flow/click#' || seq || ' -> flow/~0#' || (row_number() over (order by seq) - 1) as lineage
    from c where event_type = 'click' and cents % 2 = 0""")
def registry_component(spark, sf_dir):
    f = FlowBuilder("flow")
    f.from_("scale_cents", f.tap("click"))
    return text(f.build().lower(spark, {"flow/click": channel(spark, sf_dir, "click", all_arrivals=False)})["flow/~0"], "seq", "scaled")


def planned() -> FlowBuilder:
    f = FlowBuilder("plan").with_sla_config(cores=1)
    a = f.source("lidar", lambda s: s.range(0), interval_us=100_000)
    b = f.source("imu", lambda s: s.range(0), interval_us=10_000)
    x = a.map(v=F.lit(1)).with_wcet(8000)
    y = b.map(v=F.lit(1))
    f.join(x, y, lambda p, q: {"v": p("v")}).with_wcet(3000).with_sla(50_000)
    return f


@recursive
@query(""", node(output, input, wcet) as (values ('plan/~0', 'plan/lidar', 8000), ('plan/~1', 'plan/imu', 100), ('plan/~2', 'plan/~0', 3000), ('plan/~2', 'plan/~1', 3000)),
walk as (select 'plan/~2' as here, 0 as spent, ['plan/~2'] as way union all
    select input, spent + wcet + 20, list_append(way, input) from walk join node on output = here where not list_contains(way, input)),
worst as (select way from walk where here in ('plan/lidar', 'plan/imu') order by spent desc limit 1),
run as (select distinct output, wcet from node, worst where list_contains(way, output))
select output as channel, cast(floor(50000 * (wcet * 1.0 / sum(wcet) over ())) as int) as budget_us from run""")
def sla_plan(spark, sf_dir):
    budgets = planned().build().report.budgets
    return spark.createDataFrame([(k, v) for k, v in budgets.items()], "channel string, budget_us int")


@recursive
@query(""", node(output, input, wcet) as (values ('plan/~0', 'plan/lidar', 8000), ('plan/~1', 'plan/imu', 100), ('plan/~2', 'plan/~0', 3000), ('plan/~2', 'plan/~1', 3000)),
walk as (select goal as here, goal, 0 as spent, [goal] as way from (select unnest(['plan/~2', 'plan/~0', 'plan/~1']) as goal) union all
    select input, goal, spent + wcet + 20, list_append(way, input) from walk join node on output = here where not list_contains(way, input)),
far as (select goal, max(spent) as planned, arg_max(way, spent) as way from walk where here in ('plan/lidar', 'plan/imu') group by goal),
cost as (select distinct output, wcet from node)
select goal as endpoint, planned as planned_us, deadline as deadline_us, array_to_string(way, ' <- ') as path,
    (select 'map -> ' || output from cost where list_contains(way, output) order by wcet desc limit 1) as worst
from far join (values ('plan/~2', 10000), ('plan/~0', 8020), ('plan/~1', 119)) as t(endpoint, deadline) on goal = endpoint where planned > deadline""")
def sla_violations(spark, sf_dir):
    """Deadlines that planned paths miss, with the path and its costliest node; one that is met exactly is none."""
    nodes = [sla.Node("map", ("plan/lidar",), "plan/~0", 8000), sla.Node("map", ("plan/imu",), "plan/~1"), sla.Node("join", ("plan/~0", "plan/~1"), "plan/~2", 3000)]
    r = sla.plan({"plan/lidar": 100_000, "plan/imu": 10_000}, nodes, [("plan/~2", 10_000), ("plan/~0", 8020), ("plan/~1", 119)], sla.Config(cores=1))
    rows = [(v.endpoint, v.planned_us, v.deadline_us, " <- ".join(v.path), v.worst) for v in r.violations]
    return spark.createDataFrame(rows, "endpoint string, planned_us int, deadline_us int, path string, worst string")


DAG_FILE = "# a line of cameras\n[component cam]\ntype = Camera\ninterval_ms=50\n\n; joined\n[component fuse]\ntype=Fuse\ninputs = cam, lidar ,, imu \n"


@query(f""", d as (select trim(y) as y, row_number() over () as n from (select unnest(string_split('{DAG_FILE}', chr(10))) as y)),
g as (select *, sum(case when y like '[%' then 1 else 0 end) over (order by n) as k from d where y <> '' and y[1] not in ('#', ';')),
v as (select k, case when y like '[%' then 'name' else trim(split_part(y, '=', 1)) end as key, case when y like '[%' then trim(y[12:-2]) else trim(split_part(y, '=', 2)) end as value from g)
select max(value) filter (key = 'name') as name, max(value) filter (key = 'type') as type,
    coalesce(array_to_string(list_filter(list_transform(string_split(max(value) filter (key = 'inputs'), ','), lambda x: trim(x)), lambda x: x <> ''), ' '), '') as inputs,
    coalesce(cast(max(value) filter (key = 'interval_ms') as int), 0) as interval_ms from v group by k""")
def dag_file(spark, sf_dir):
    """A component file, read."""
    rows = [(c.name, c.type, " ".join(c.inputs), c.interval_ms) for c in dagfile.parse(DAG_FILE)]
    return spark.createDataFrame(rows, "name string, type string, inputs string, interval_ms int")


#: FNV-1a over the canonical text of the graph of ``ir_hash``.
CANONICAL = "flow=g;ver=1;n=source;o=g/a;w=0;t=0;n=map;i=g/a;o=g/~0;w=0;t=1;n=source;o=g/b;w=0;t=2;n=map;i=g/b;o=g/~1;w=0;t=3;"


@recursive
@query(f""", f as (select 0 as n, cast(14695981039346656037 as hugeint) as h union all
    select n + 1, xor(h, cast(ascii(substr('{CANONICAL}', n + 1, 1)) as hugeint)) * 1099511628211 % 18446744073709551616 from f where n < {len(CANONICAL)})
    select true as equal_hash, true as other_differs, 4 as n_nodes, lower(to_hex(cast(h as ubigint))) as stable_hash from f where n = {len(CANONICAL)}""")
def ir_hash(spark, sf_dir):
    """The order of declaration does not change the hash; another cost does."""
    f = FlowBuilder("g")
    f.source("a", lambda s: s.range(0)).map(v=F.lit(1))
    f.source("b", lambda s: s.range(0)).map(v=F.lit(1))
    g = FlowBuilder("g")
    b, a = g.source("b", lambda s: s.range(0)), g.source("a", lambda s: s.range(0))
    b.map(v=F.lit(1))
    last = a.map(v=F.lit(1))
    one, two = f.build().graph(), g.build().graph()
    last.with_wcet(5)
    three = g.build().graph()
    rows = [(one.stable_hash() == two.stable_hash(), one.stable_hash() != three.stable_hash(), len(ir.Graph.normalized(one).nodes), one.stable_hash())]
    return spark.createDataFrame(rows, "equal_hash boolean, other_differs boolean, n_nodes int, stable_hash string")


@query("""select event_id, user_id as u32, cents / 100 as d, cents % 2 = 0 as b, cents as v0, cents + 1 as v1 from e""")
def pod_decode(spark, sf_dir):
    """Binary payloads packed and decoded by a field table."""
    return trec.decode_pod(packed_events(spark, sf_dir), POD).select("event_id", "u32", "d", "b", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"))


def packed_events(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return trec.pack_pod(e.select("event_id", F.col("user_id").alias("u32"), (F.col("cents") / 100).alias("d"), (F.col("cents") % 2 == 0).alias("b"), F.array("cents", F.col("cents") + 1).alias("v")), POD)


@query("""select event_id, 'u32=' || user_id || ' d=' || format('{:.6g}', cents / 100.0) || ' b=' || cast(cents % 2 = 0 as varchar) || ' v=' || cents || ',' || (cents + 1) as text from e""")
def pod_text(spark, sf_dir):
    """Binary payloads rendered as text by a field table."""
    return trec.render_pod(packed_events(spark, sf_dir), POD).select("event_id", "text")


POD = [trec.Field("u32", 0, "uint32"), trec.Field("d", 8, "double"), trec.Field("b", 16, "bool"), trec.Field("v", 24, "int64", 2)]


@query("select event_id, cents * 2 as double_cents from e where event_type = 'click'")
def stream_map(spark, sf_dir):
    s = twins.stream_of(spark, f"{sf_dir}/events.parquet").filter("event_type = 'click'")
    return twins.drain(s.select("event_id", (F.round(F.col("value") * 100).cast("bigint") * 2).alias("double_cents")), "map")


@query(ORACLES["join_zip_by_key"].removeprefix(WITH))
def stream_join_zip(spark, sf_dir):
    s = twins.stream_of(spark, f"{sf_dir}/events.parquet").filter("event_type in ('click', 'view')")
    rows = s.select("user_id", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("side"), "ts", "event_id")
    return twins.drain(twins.zip_stream(rows, ["user_id"], "side", ["ts", "event_id"]), "zip")


def stream_step(state, row):
    n, total = state[0] + 1, state[1] + round(row.value * 100)
    return [n, total], [(row.event_id, n, total)]


@query("""select user_id, event_id, row_number() over w as n, cast(sum(cents) over w as bigint) as total from e where event_type = 'purchase'
    window w as (partition by user_id order by ts_ns, event_id)""")
def stream_stateful(spark, sf_dir):
    s = twins.stream_of(spark, f"{sf_dir}/events.parquet").filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return twins.drain(twins.fold_stream(s, ["user_id"], ["ts", "event_id"], lambda: [0, 0], stream_step, "user_id long, event_id long, n long, total long"), "fold")


@query(ORACLES["stream_stateful"].removeprefix(WITH))
def stream_restart(spark, sf_dir):
    """The same fold in two runs: the second finds new files and the state that the first has left."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    given, out = fresh_path(spark, "given"), fresh_path(spark, "folded")
    half = F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    for part in (F.col("ts").cast("timestamp_ntz") < half, F.col("ts").cast("timestamp_ntz") >= half):
        rows.filter(part).write.mode("append").parquet(given)
        fold = twins.fold_stream(twins.stream_of(spark, given), ["user_id"], ["ts", "event_id"], lambda: [0, 0], stream_step, "user_id long, event_id long, n long, total long")
        done = twins.drain(fold, "fold", out)
    return done


@query("""select t.event_id as trigger_id, d.event_id as data_id from e t join e d on d.ts_ns between t.ts_ns - 3600000000000 and t.ts_ns
    where t.event_type = 'error' and d.event_type = 'click'""")
def stream_span_join(spark, sf_dir):
    s = twins.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    return twins.drain(twins.span_stream(s.filter("event_type = 'error'"), s.filter("event_type = 'click'"), 3600), "span")


@query("""select user_id, event_id as id, coalesce(len(f), 0) as n, coalesce(f[1].id, -1) as data_lo, coalesce(f[len(f)].id, -1) as data_hi from (
    select *, list_filter(last, lambda x: x.ts_ns between ts_ns - 172800000000000 and ts_ns) as f from (
    select *, list_slice(list({'id': event_id, 'ts_ns': ts_ns}) filter (event_type = 'click') over (partition by user_id order by ts_ns, event_id), -5, -1) as last
    from e where event_type in ('error', 'click')) where event_type = 'error')""")
def stream_span_history(spark, sf_dir):
    """Triggers and the last 5 data messages of their user before them, as they come; empty slices stay."""
    s = twins.stream_of(spark, f"{sf_dir}/events.parquet").filter("event_type in ('error', 'click')")
    rows = s.select("user_id", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("is_trigger"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    kinds = "user_id long, id long, n long, data_lo long, data_hi long"
    found = twins.drain(twins.span_history(rows, ["user_id"], ["ts_ns", "id"], "is_trigger", "ts_ns", -48 * HOUR, 0, kinds, depth=5), "slices")
    return found.fillna(-1)
