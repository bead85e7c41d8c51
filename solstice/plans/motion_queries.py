"""Orientation from rates and anchors (line items as samples a millisecond or more apart, some with gaps), filters and fading states of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, gates, interpolation, motion, recurrence
from .tables import DAY, EVENTS, events, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _motion(spark, d) -> tuple[DataFrame, DataFrame]:
    """Rates and anchors: the line number is the source, an order is a millisecond, and the orders of each 64 ms are anchors that turn about z."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("k")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"))
    rows = calibration.stored(rows)
    t = (F.col("k") / 1000.0).alias("t")
    rates = rows.select("source", t, ((F.col("a") - 25) / 25).alias("wx"), ((F.col("b") - 0.05) * 20).alias("wy"), ((F.col("c") - 0.04) * 20).alias("wz"))
    zero = F.lit(0.0)
    anchors = rows.where("k % 64 = 0").select("source", t, zero.alias("qx"), zero.alias("qy"), F.sin(F.col("k") / 1000.0).alias("qz"), F.cos(F.col("k") / 1000.0).alias("qw"))
    return rates, anchors


def _axes(df: DataFrame) -> DataFrame:
    """The turned x axis instead of a pose, rounded: it does not depend on the pose's sign."""
    x, y, z, w = (F.col(f"q{c}") for c in "xyzw")
    return df.withColumns({"vx": F.round(1 - 2 * (y * y + z * z), 6) + 0.0, "vy": F.round(2 * (x * y + z * w), 6) + 0.0, "vz": F.round(2 * (x * z - y * w), 6) + 0.0}).drop("qx", "qy", "qz", "qw")


def _times(a: str, b: str) -> str:
    """The product of two quaternions whose columns are {a}x to {a}w and {b}x to {b}w, as x to w."""
    a, b = ([f"{p}{c}" for c in "xyzw"] for p in (a, b))
    return (
        f"{a[3]} * {b[0]} + {a[0]} * {b[3]} + {a[1]} * {b[2]} - {a[2]} * {b[1]} as x, {a[3]} * {b[1]} - {a[0]} * {b[2]} + {a[1]} * {b[3]} + {a[2]} * {b[0]} as y, "
        f"{a[3]} * {b[2]} + {a[0]} * {b[1]} - {a[1]} * {b[0]} + {a[2]} * {b[3]} as z, {a[3]} * {b[3]} - {a[0]} * {b[0]} - {a[1]} * {b[1]} - {a[2]} * {b[2]} as w"
    )


def _exp(v: str) -> str:
    """The quaternion of the rotation vector {v}x to {v}z, as x to w."""
    size = f"sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z)"
    part = f"case when {size} < 1e-12 then 0.5 else sin({size} / 2) / {size} end"
    return f"{v}x * {part} as x, {v}y * {part} as y, {v}z * {part} as z, cos({size} / 2) as w"


def _oriented(queries: str) -> str:
    """Common table expressions: `posed` has the orientation x to w and the status of each row (source, id, t) of the table expression, by a fold from its anchor."""
    steps = "ceil(({0} - {1}) / 0.001::double - 1e-9::double)"
    middle = lambda c, n, end: f"(w{c} + ({end} - w{c}) * ((i + 0.5::double) / {n})) * (dt / {n}) as v{c}"
    return f"""
ask as materialized ({queries}),
rows as (select l_linenumber as source, l_orderkey as k, (avg(l_quantity) - 25) / 25 as wx, (avg(l_discount) - 0.05::double) * 20 as wy, (avg(l_tax) - 0.04::double) * 20 as wz from lineitem group by all),
s as materialized (select *, k / 1000.0::double as t, lead(k / 1000.0::double) over o as t2, lead(wx) over o as ux, lead(wy) over o as uy, lead(wz) over o as uz from rows window o as (partition by source order by k)),
a as materialized (select source, t, lead(t) over (partition by source order by t) as t2, 0::double as px, 0::double as py, sin(t) as pz, cos(t) as pw, lead(sin(t)) over (partition by source order by t) as nz, lead(cos(t)) over (partition by source order by t) as nw from s where k % 64 = 0),
met as materialized (select q.source, q.id, q.t, s.t as st, s.t2 as st2, s.wx, s.wy, s.wz, s.ux, s.uy, s.uz from ask q asof left join s on q.source = s.source and q.t >= s.t),
bound as materialized (select m.*, a.t as fix, a.t2 as fix2, a.px, a.py, a.pz, a.pw, a.nz, a.nw from met m asof left join a on m.source = a.source and m.t >= a.t),
n as (select s.source, a.t as fix, s.t, s.t2, wx, wy, wz, ux, uy, uz, s.t2 - s.t as dt, {steps.format('s.t2', 's.t')} as n from s asof join a on s.source = a.source and s.t >= a.t where s.t2 <= a.t2 and a.t2 - a.t <= 1.000001::double and s.t2 - s.t <= 0.010001::double),
sub as (select source, fix, t, t2, n, i, {', '.join(middle(c, 'n', f'u{c}') for c in 'xyz')} from (select *, unnest(range(n::bigint)) as i from n)),
inc as materialized (select source, fix, t2, i = n - 1 as done, row_number() over (partition by source, fix order by t, i) as k, {_exp('v')} from sub),
fold(source, fix, k, t2, done, x, y, z, w) as (select source, fix, k, t2, done, x, y, z, w from inc where k = 1 union all
 select source, fix, k, t2, done, {_times('f', 'g')} from (select i.source, i.fix, i.k, i.t2, i.done, f.x as fx, f.y as fy, f.z as fz, f.w as fw, i.x as gx, i.y as gy, i.z as gz, i.w as gw from fold f join inc i on i.source = f.source and i.fix = f.fix and i.k = f.k + 1)),
upto as materialized (select source, fix, t2, x, y, z, w from fold where done union all select source, t, t, 0, 0, 0, 1 from a),
gaps as materialized (select distinct a.source, a.t as fix from a join s on s.source = a.source and s.t >= a.t and s.t < a.t2 where s.t2 - s.t > 0.010001::double),
told as (select b.*, case when st is null or (st2 is null and t > st) or (t > st and st2 - st > 0.010001::double) then 'rates' when fix is null or fix2 is null or fix2 - fix > 1.000001::double then 'anchors' when (source, fix) in (select (source, fix) from gaps) then 'gap' else 'ok' end as status from bound b),
tail as materialized (select source, id, unnest(range(n::bigint)) as i, n, dt, wx, wy, wz, ex, ey, ez from (
 select source, id, t - st as dt, {steps.format('t', 'st')} as n, wx, wy, wz, {', '.join(f'w{c} + (u{c} - w{c}) * ((t - st) / (st2 - st)) as e{c}' for c in 'xyz')} from told where status = 'ok' and t > st)),
bits as materialized (select source, id, i, {_exp('v')} from (select source, id, i, {', '.join(middle(c, 'n', f'e{c}') for c in 'xyz')} from tail)),
last(id, i, x, y, z, w) as (select t.id, -1::bigint, u.x, u.y, u.z, u.w from told t join upto u on u.source = t.source and u.fix = t.fix and u.t2 = t.st where t.status = 'ok' union all
 select id, i, {_times('f', 'g')} from (select b.id, b.i, f.x as fx, f.y as fy, f.z as fz, f.w as fw, b.x as gx, b.y as gy, b.z as gz, b.w as gw from last f join bits b on b.id = f.id and b.i = f.i + 1)),
ended as (select id, arg_max(x, i) as lx, arg_max(y, i) as ly, arg_max(z, i) as lz, arg_max(w, i) as lw from last group by id),
whole as (select source, fix, -x as cx, -y as cy, -z as cz, w as cw from upto u where t2 = (select a.t2 from a where a.source = u.source and a.t = u.fix) and t2 > fix),
aim as (select source, t as fix, {_times('h', 'm')} from (select source, t, -px as hx, -py as hy, -pz as hz, pw as hw, 0::double as mx, 0::double as my, nz as mz, nw as mw from a)),
off as (select source, fix, {_times('c', 'd')} from (select whole.*, aim.x as dx, aim.y as dy, aim.z as dz, aim.w as dw from whole join aim using (source, fix))),
size as (select *, sqrt(x * x + y * y + z * z) as n, case when w < 0 then -1 else 1 end as g from off),
drift as materialized (select source, fix, case when n < 1e-12 then 2 else 2 * atan2(n, g * w) / n end * g * x as vx, case when n < 1e-12 then 2 else 2 * atan2(n, g * w) / n end * g * y as vy, case when n < 1e-12 then 2 else 2 * atan2(n, g * w) / n end * g * z as vz from size),
led as (select id, {_times('p', 'l')} from told join ended using (id)),
eased as (select id, {_exp('v')} from (select id, vx * part as vx, vy * part as vy, vz * part as vz from (select id, (t - fix) / (fix2 - fix) as part, d.vx, d.vy, d.vz from told join drift d using (source, fix) where status = 'ok'))),
posed as materialized (select told.source, told.id, told.t, status, x, y, z, w from told left join (select id, {_times('f', 'g')} from (select led.id, led.x as fx, led.y as fy, led.z as fz, led.w as fw, e.x as gx, e.y as gy, e.z as gz, e.w as gw from led join eased e using (id))) using (id))"""


_AXES = "round(1 - 2 * (y * y + z * z), 6) + 0.0::double as vx, round(2 * (x * y + z * w), 6) + 0.0::double as vy, round(2 * (x * z - y * w), 6) + 0.0::double as vz"


@query(f"""with recursive {_oriented("select (1 + p_partkey % 7)::int as source, p_partkey as id, p_partkey * 0.0073::double + 0.00011::double as t from part")} select source, id, round(t, 6) as t, status, {_AXES} from posed""")
def anchored_orientation(spark, d) -> DataFrame:
    """The orientation at each part's time."""
    key = F.col("p_partkey")
    asks = table(spark, d, "part").select((1 + key % 7).cast("int").alias("source"), key.alias("id"), (key * 0.0073 + 0.00011).alias("t"))
    return _axes(motion.anchored_orientation(asks, *_motion(spark, d))).withColumn("t", F.round("t", 6))


@query(f"""with recursive {_oriented("select 1 as source, s_suppkey * 33 + r as id, s_suppkey * 0.14::double + 0.2001::double + (r - 16) / 32.0::double * 0.02::double as t from supplier, range(33) r(r)")},
f as (select id // 33 as id, (id % 33)::int as row, status, x, y, z, w from posed), bad as (select id, min(status) as status from f where status <> 'ok' group by id),
turned as (select id, row, {_times('h', 'm')} from (select a.id, a.row, -a.x as hx, -a.y as hy, -a.z as hz, a.w as hw, c.x as mx, c.y as my, c.z as mz, c.w as mw from f a join f c on c.id = a.id and c.row = 16))
select 1 as source, id, row, coalesce(b.status, 'ok') as status, case when b.id is null then round(1 - 2 * (y * y + z * z), 6) + 0.0::double end as vx, case when b.id is null then round(2 * (x * y + z * w), 6) + 0.0::double end as vy, case when b.id is null then round(2 * (x * z - y * w), 6) + 0.0::double end as vz from turned left join bad b using (id)""")
def row_poses(spark, d) -> DataFrame:
    """Each supplier as a frame of 20 ms: how its 33 rows are turned against its centre."""
    key = F.col("s_suppkey")
    frames = table(spark, d, "supplier").select(F.lit(1).alias("source"), key.alias("id"), (key * 0.14 + 0.2001).alias("centre"), F.lit(0.02).alias("readout"))
    return _axes(motion.row_poses(frames, *_motion(spark, d)))


_LOW = dict(zip(("b0", "b1", "b2", "b3", "a0", "a1", "a2", "a3"), (repr(float(x)) + "::double" for part in recurrence.butterworth3(0.5, 10) for x in part), strict=True))


def _filtered(rows: str) -> str:
    """Two columns of {rows} (user_id, k from 1, x, y) through the difference equation, as the body of a recursive table (user_id, k, x, y and the states)."""

    def step(c: str, s: str) -> str:
        y = f"({_LOW['b0']} * n.{c} + {s}0)"
        return f"{y} as {c}, " + ", ".join(f"{_LOW[f'b{i + 1}']} * n.{c} - {_LOW[f'a{i + 1}']} * {y}" + (f" + {s}{i + 1}" if i < 2 else "") for i in range(3))

    settled = [" + ".join(f"({_LOW[f'b{i}']} - {_LOW[f'a{i}']})" for i in range(k, 4)) for k in (1, 2, 3)]
    first = ", ".join(f"({settled[i]}) * {c} as {s}{i}" for c, s in (("x", "p"), ("y", "q")) for i in range(3))
    start = f"(select *, {first} from {rows} where k = 1)"
    return f"select user_id, n.k, {step('x', 'p')}, {step('y', 'q')} from {start} n union all select n.user_id, n.k, {step('x', 'p')}, {step('y', 'q')} from r join {rows} n on n.user_id = r.user_id and n.k = r.k + 1"


_R = "(user_id, k, x, p0, p1, p2, y, q0, q1, q2)"


@query(f"""with recursive {EVENTS}, e as (select user_id, row_number() over (partition by user_id order by us, event_id) as i, count(*) over (partition by user_id) as n, value as x, value % 7 as y from ev),
v as materialized (select user_id, n, i + 12 as k, x, y from e where n > 12 union all select a.user_id, a.n, 14 - b.i, 2 * a.x - b.x, 2 * a.y - b.y from e a join e b using (user_id) where a.n > 12 and a.i = 1 and b.i between 2 and 13
 union all select a.user_id, a.n, 2 * a.n - b.i + 12, 2 * a.x - b.x, 2 * a.y - b.y from e a join e b using (user_id) where a.n > 12 and a.i = a.n and b.i between a.n - 12 and a.n - 1),
f{_R} as ({_filtered('v').replace('from r ', 'from f r ')}), g as materialized (select f.user_id, v.n + 25 - f.k as k, f.x, f.y from f join v using (user_id, k)), h{_R} as ({_filtered('g').replace('from r ', 'from h r ')})
select e.user_id, round(i / 10.0::double, 1) as t, case when n > 12 then 'ok' else 'short' end as status, round(h.x, 6) as x, round(h.y, 6) as y, case when n > 12 then 1.0::double end as z from e left join h on h.user_id = e.user_id and h.k = e.n + 13 - e.i""")
def zero_phase_lowpass(spark, d) -> DataFrame:
    """Users' values, taken as ten samples a second, without what is faster than half a Hz."""
    e = recurrence.numbered(events(spark, d), "user_id", F.floor(F.col("us") / DAY), ["us", "event_id"])
    rows = e.select(F.col("user_id").alias("source"), ((F.col("k") + 1) / 10).alias("t"), F.col("value").alias("x"), (F.col("value") % 7).alias("y"), F.lit(1.0).alias("z"))
    out = recurrence.zero_phase_lowpass(rows, 0.5)
    return out.select(F.col("source").alias("user_id"), F.round("t", 1).alias("t"), "status", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"""with recursive {EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) as k from ev), r as (select user_id, event_id, k, case when event_type <> 'error' then value end as s from n where k = 1 union all
 select n.user_id, n.event_id, n.k, case when n.event_type <> 'error' then case when r.s is null then n.value else r.s + 0.3137::double * (n.value - r.s) end else r.s * 0.6113::double end from r join n on n.user_id = r.user_id and n.k = r.k + 1) select event_id, round(s, 6) as state from r""")
def fading_state(spark, d) -> DataFrame:
    """The decaying state of users' values without a limit, composed over chunks."""
    out = recurrence.fading_state(events(spark, d), "user_id", F.floor(F.col("us") / DAY), ["us", "event_id"], F.col("value"), F.col("event_type") != "error", 0.3137, 0.6113, ["event_id"])
    return out.select("event_id", F.round("state", 6).alias("state"))


def _about(axis: int, angle: np.ndarray) -> np.ndarray:
    return motion.exp_rotation(np.eye(3)[axis] * np.asarray(angle, float)[:, None])


def _swing(source: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The poses of sources at times: slow swings about three axes."""
    turns = [_about(2, 0.6 * np.sin(0.31 * t + source)), _about(1, 0.4 * np.sin(0.23 * t)), _about(0, 0.5 * np.sin(0.17 * t + 2 * source))]
    return motion.product(motion.product(turns[0], turns[1]), turns[2])


def _made(df: DataFrame, make, schema: str) -> DataFrame:
    """Each batch of rows through a NumPy function of the frame."""
    return df.mapInPandas(lambda batches: (make(rows) for rows in batches), schema)


def _with(df: DataFrame, make, schema: str, inputs: list[str]) -> DataFrame:
    """df with columns that a NumPy function makes of others. Unlike _made()'s they are worked out only where they are read, and for rows that are left, so df need not be stored."""
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def made(*columns: pd.Series) -> pd.DataFrame:
        out = make(*[c.to_numpy() for c in columns])
        return pd.DataFrame({n: out[:, k] for k, n in enumerate(names)})

    return df.withColumn("_made", made(*inputs)).select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in names])


def _poses(spark, d) -> DataFrame:
    """Of five sources, each order a fiftieth of a second."""
    rows = table(spark, d, "orders").select(F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("source"), (F.col("o_orderkey") / 50.0).alias("t"))
    return _with(rows, _swing, "qx double, qy double, qz double, qw double", ["source", "t"])


@query()
def gravity_fit(spark, d) -> DataFrame:
    """Parts as times at which a mounted lens sees down, with a shift of its clock; source 4 has too few. The mount and the shift are found again and scored."""
    key = F.col("p_partkey")
    seen = table(spark, d, "part").select((key % 5).cast("int").alias("source"), (key * 0.13 + 1.3).alias("t"), key).where("source < 4 or p_partkey < 25").select("source", "t")

    def make(rows):
        s, t = rows.source.to_numpy(), rows.t.to_numpy()
        mount = motion.product(_about(2, -1.2 - 0.1 * s), _about(0, 0.05 + 0.06 * s))
        world = motion.product(_swing(s, t + 0.07 * s - 0.1), mount)
        down = calibration.turned(motion.conjugate(world), np.tile([0.0, 0.0, 1.0], (len(s), 1)))
        return rows.assign(**{f"d{c}": down[:, k] for k, c in enumerate("xyz")})

    seen, poses = calibration.stored(_made(seen, make, "source int, t double, dx double, dy double, dz double")), _poses(spark, d)
    fits = calibration.stored(calibration.fit_gravity(seen, poses))
    scores = calibration.score_gravity(seen, poses, fits.where("status = 'fitted'")).select("source", F.col("largest_degrees").alias("scored_degrees"))
    return fits.join(scores, "source", "left").select("source", "samples", F.transform("mount", lambda x: F.round(x, 3)).alias("mount"), F.round("shift", 3).alias("shift"), F.round("largest_degrees", 2).alias("largest_degrees"), F.round("scored_degrees", 2).alias("scored_degrees"), "status")


@query()
def timing_fit(spark, d) -> DataFrame:
    """Line items as rays tracked between two frames of a lens that reads its rows in 20 ms, with a shift and a scale of its own for each source; they are found again and judged on the blocks held out."""
    c = F.col
    rows = table(spark, d, "lineitem").select((c("l_linenumber") % 5).cast("int").alias("source"), F.floor(c("l_orderkey") / 5).alias("pair"), (c("l_partkey") % 101 / 100 - 0.5).alias("r0"), (c("l_suppkey") % 101 / 100 - 0.5).alias("r1"), (c("l_extendedprice") % 7).alias("a"), (c("l_quantity") / 20).alias("b"))

    def make(s, t0, r0, r1, a, b):
        ray = np.stack([np.cos(a) * np.cos(b), np.sin(a) * np.cos(b), np.sin(b)], axis=1)
        at = [t0 + 0.1 * k + r * 0.02 * (1 + 0.1 * s) + 0.005 * s - 0.01 for k, r in ((0, r0), (1, r1))]
        return np.concatenate([ray, calibration.turned(motion.product(motion.conjugate(_swing(s, at[1])), _swing(s, at[0])), ray)], axis=1)

    rows = rows.select("*", (c("pair") * 0.1 + 0.5).alias("t0")).select("*", (c("t0") + 0.1).alias("t1"))
    tracks = _with(rows, make, ", ".join(f"{n}{x} double" for n in "ab" for x in "xyz"), ["source", "t0", "r0", "r1", "a", "b"]).drop("a", "b")
    out = calibration.fit_image_timing(tracks, _poses(spark, d), 0.02)
    return out.select("source", "tracks", F.round("shift", 4).alias("shift"), F.round("scale", 2).alias("scale"), (c("after_median") < c("before_median")).alias("better"), "status", "reasons")


@query("""with k as (select (p_partkey % 5)::int as source, ((p_partkey * 37) % 360)::double as x, avg(p_retailprice) as y from part group by all), e as (select source, min(x) as a, max(x) as z from k group by source),
p as (select * from k union all select source, x + 360, y from k join e using (source) where x = a union all select source, x - 360, y from k join e using (source) where x = z),
q as (select o_orderkey, (o_custkey % 5)::int as source, fmod(o_orderkey * 7.3::double, 360.0::double) as x from orders)
select o_orderkey, round(a.y + (b.y - a.y) * ((q.x - a.x) / (b.x - a.x)), 6) as y from q asof join p a on q.source = a.source and q.x >= a.x asof join p b on q.source = b.source and q.x < b.x""")
def periodic_interpolation(spark, d) -> DataFrame:
    """Prices of parts around a ring of degrees, read at each order's angle."""
    key = F.col("p_partkey")
    knots = table(spark, d, "part").select((key % 5).cast("int").alias("source"), (key * 37).alias("x"), F.col("p_retailprice").alias("y"))
    asks = table(spark, d, "orders").select((F.col("o_custkey") % 5).cast("int").alias("source"), F.col("o_orderkey"), (F.col("o_orderkey") * F.lit(7.3)).alias("x"), F.lit(0).alias("id"))
    return interpolation.periodic_linear(asks, knots, "x", "y", 360.0).select("o_orderkey", F.round("y", 6).alias("y"))


@query("""with g as (select p_partkey // 20 as row, p_partkey % 20 as col, p_retailprice as value from part) select row, col, value from g union all select row, col + 20, value from g where col < 3 union all select row, col - 20, value from g where col >= 17""")
def wrap_padding(spark, d) -> DataFrame:
    """Parts as a ring of 20 columns with three more on either side."""
    key = F.col("p_partkey")
    cells = table(spark, d, "part").select(F.floor(key / 20).alias("row"), (key % 20).alias("col"), F.col("p_retailprice").alias("value"))
    return interpolation.wrap_columns(cells, "col", 20, 3)


@query("""with f as (select l_orderkey as source, l_partkey % 70 as number, l_suppkey % 3 as wire from lineitem), w as (select * from f join (select unnest([2, 3, 4, 5, 19, 22, 26, 27, 31, 53, 54, 56, 65]) as number, 2 as w union all
 select unnest([15, 20, 24, 29, 40, 42, 43, 62]), 0 union all select unnest([25, 28]), 1) using (number)), g as (select source, number, count(*) as n, bool_or(wire <> w) as other from w group by all)
select source, number, 'twice' as rule from g where n > 1 union all select source, number, 'wire type' from g where other""")
def metadata_contract(spark, d) -> DataFrame:
    """Line items as the metadata fields of their orders."""
    fields = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 70).alias("number"), (F.col("l_suppkey") % 3).alias("wire"))
    return gates.metadata_violations(fields)
