"""Time-series operators on the events table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import interpolation as I
from ..operators import matching, motion
from ..operators import series as S
from ..streaming import tracks
from ..streaming.replay import replay
from .tables import DAY, EVENTS, SERIES, events, table

VOID, INVALID = "event_type = 'error'", "value > 200"

_MARKED = f"""with {EVENTS}, m as (
    select *, event_type = 'error' as void, value > 200 as bad from ev
), l as (
    select *, last_value(case when not void then us end ignore nulls) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as seen from m
), b as (
    select *, sum(case when void or bad or coalesce(us - seen > {DAY}, false) then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as run from l
), points as (select * from b where not void and not bad), segs as (
    select user_id, run, count(*) as points, min(us) as first_us, max(us) as last_us, min(value) as min_value, max(value) as max_value from points group by user_id, run
)"""


def track_segments(spark, d) -> DataFrame:
    return S.track_segments(events(spark, d), SERIES, F.expr(VOID), F.expr(INVALID), DAY, "value")


TRACK_SEGMENTS = _MARKED + """
select user_id, row_number() over (partition by user_id order by run) as segment_id, points, first_us, last_us, (last_us - first_us) / 1e6::double as duration_s, min_value, max_value from segs"""


def track_segment_summary(spark, d) -> DataFrame:
    parts = S.track_segments(events(spark, d), SERIES, F.expr(VOID), F.expr(INVALID), DAY, "value")
    return parts.groupBy("user_id").agg(
        F.sum("points").alias("points"), F.count("*").alias("segments"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("points").alias("longest")
    )


TRACK_SEGMENT_SUMMARY = _MARKED + """
select user_id, sum(points)::bigint as points, count(*) as segments, min(first_us) as first_us, max(last_us) as last_us, max(points) as longest from segs group by user_id"""


def track_void_invalid_counts(spark, d) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("samples"), F.count_if(F.expr(VOID)).alias("void"), F.count_if(~F.expr(VOID) & F.expr(INVALID)).alias("invalid"), F.count_if(~F.expr(VOID) & ~F.expr(INVALID)).alias("points")
    )


TRACK_VOID = """select user_id, count(*) as samples, count(*) filter (event_type = 'error') as void, count(*) filter (event_type <> 'error' and value > 200) as invalid,
 count(*) filter (event_type <> 'error' and value <= 200) as points from events group by user_id"""


def monotonic_summary(spark, d) -> DataFrame:
    """In the order of recording (event_id)."""
    step = F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = events(spark, d).withColumn("step", step)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("step") <= 0).alias("not_increasing"), F.min("step").alias("least_step"))


MONOTONIC = f"""with {EVENTS}, s as (select user_id, us - lag(us) over (partition by user_id order by event_id) as step from ev)
select user_id, count(*) as n, count(*) filter (step <= 0) as not_increasing, min(step) as least_step from s group by user_id"""


def cadence_summary(spark, d) -> DataFrame:
    out = S.cadence(events(spark, d), SERIES)
    return out.withColumns({c: F.round(c, 3) for c in ("median_dt", "p95_dt")})


CADENCE = f"""with {EVENTS}, s as (select user_id, us - lag(us) over (partition by user_id order by us, event_id) as dt from ev), m as (
 select user_id, count(dt) as steps, quantile_cont(dt, 0.5) as med, quantile_cont(dt, 0.95) as p95, max(dt) as max_dt from s where dt is not null group by user_id)
select user_id, steps, round(med, 3) as median_dt, round(p95, 3) as p95_dt, max_dt, (select count(*) from s where s.user_id = m.user_id and dt > 2 * med) as gaps from m"""


def reading_summary(spark, d) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return events(spark, d).groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), p(0.5).alias("median"), p(0.95).alias("p95"), F.max("value").alias("high"), F.round((F.max("value") - F.min("value")) / 2, 6).alias("half_range")
    )


READING = """select event_type, count(*) as n, min(value) as low, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, max(value) as high,
 round((max(value) - min(value)) / 2, 6) as half_range from events group by event_type"""

#: A week inside the events' time, as microseconds.
SPAN = (1_705_000_000_000_000, 1_705_604_800_000_000)


def span_limited_gaps(spark, d) -> DataFrame:
    return S.span_gaps(events(spark, d), SERIES, *SPAN, DAY)


SPAN_GAPS = f"""with {EVENTS}, s as (select user_id, us, lag(us) over (partition by user_id order by us, event_id) as prev from ev), n as (
 select * from s where us > {SPAN[0]} and prev < {SPAN[1]})
select user_id, count(*) as steps, max(us - prev) as max_us, count(*) filter (us - prev > {DAY}) as over_limit from n group by user_id having min(prev) <= {SPAN[0]} and max(us) >= {SPAN[1]}"""


def asof_backward(spark, d) -> DataFrame:
    e = events(spark, d)
    clicks = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    errors = e.where("event_type = 'error'").select("user_id", "us", "event_id", "value")
    out = I.asof(clicks, errors, "user_id", "us", "event_id", backward_only=True)
    return out.where("before is not null").select("event_id", "user_id", "us", F.col("before.event_id").alias("error_id"), (F.col("us") - F.col("before.us")).alias("age_us"), F.col("before.value").alias("error_value"))


ASOF = f"""with {EVENTS}, c as (select * from ev where event_type = 'click'), r as (select * from ev where event_type = 'error')
select c.event_id, c.user_id, c.us, r.event_id as error_id, c.us - r.us as age_us, r.value as error_value from c asof join r on c.user_id = r.user_id and c.us >= r.us"""


def _grid(e: DataFrame, step: int) -> DataFrame:
    """Query times of each source: whole multiples of the step from its first to its last sample."""
    ends = e.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    first, last = F.ceil(F.col("a") / step).cast("long"), F.floor(F.col("b") / step).cast("long")
    grid = ends.where(first <= last).select("user_id", F.explode(F.sequence(first, last)).alias("k"))
    return grid.select("user_id", (F.col("k") * step).alias("us"), F.col("k").alias("event_id"))


_GRID = f"""ends as (select user_id, min(us) as a, max(us) as b from ev group by user_id), grid as (
 select user_id, unnest(range((ceil(a / {DAY}::double))::bigint, (floor(b / {DAY}::double))::bigint + 1)) * {DAY} as us from ends), back as (
 select g.user_id, g.us, e.us as t0, e.value as v0 from grid g asof left join ev e on g.user_id = e.user_id and g.us >= e.us), both_sides as (
 select b.*, e.us as t1, e.value as v1 from back b asof left join ev e on b.user_id = e.user_id and b.us < e.us)"""


def asof_linear_interpolate(spark, d) -> DataFrame:
    e = events(spark, d)
    out = I.asof(_grid(e, DAY), e.select("user_id", "us", "event_id", "value"), "user_id", "us", "event_id")
    return out.select("user_id", "us", F.round(I.linear("value"), 6).alias("value"))


ASOF_LINEAR = f"""with {EVENTS}, {_GRID}
select user_id, us, round(case when t0 = us then v0 else v0 + (v1 - v0) * ((us - t0)::double / (t1 - t0)) end, 6) as value from both_sides"""


def interpolate_gap_guard(spark, d) -> DataFrame:
    e = events(spark, d)
    out = I.asof(_grid(e, DAY), e.select("user_id", "us", "event_id", "value"), "user_id", "us", "event_id")
    status = I.outcome(DAY // 4, 60_000_000)
    return out.select("user_id", "us", status.alias("status"), F.round(F.when(status == "ok", I.linear("value")), 6).alias("value"))


GAP_GUARD = f"""with {EVENTS}, {_GRID}, j as (select *, case when t0 is null or (t1 is null and t0 <> us) then 'outside'
 when us - t0 <= 60000000 or coalesce(t1 - us <= 60000000, false) then 'ok' when t1 - t0 > {DAY // 4} then 'gap' else 'ok' end as status from both_sides)
select user_id, us, status, round(case when status = 'ok' then case when t0 = us then v0 else v0 + (v1 - v0) * ((us - t0)::double / (t1 - t0)) end end, 6) as value from j"""


def _poses(e: DataFrame) -> DataFrame:
    """Orientations that turn about z by the value and about x by a tenth of it, in radians."""
    q = Q.multiply(Q.about_axis("z", F.col("value") / 50), Q.about_axis("x", F.col("value") / 500))
    return e.select("user_id", "us", "event_id", q.alias("q"))


#: With sz, cz, sx, cx the sines and cosines of the half angles, the product is as here.
_POSES = """h as (select user_id, us, event_id, sin(value / 100) as sz, cos(value / 100) as cz, sin(value / 1000) as sx, cos(value / 1000) as cx from ev),
p as (select user_id, us, event_id, cz * sx as x, sz * sx as y, sz * cx as z, cz * cx as w from h)"""


def slerp_resample(spark, d) -> DataFrame:
    e = events(spark, d)
    out = I.asof(_grid(e, DAY), _poses(e), "user_id", "us", "event_id")
    out = I.slerped(out, "q", "r")
    return out.select("user_id", "us", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in "xyzw"])


SLERP = f"""with {EVENTS}, {_POSES}, ends as (select user_id, min(us) as a, max(us) as b from ev group by user_id), grid as (
 select user_id, unnest(range((ceil(a / {DAY}::double))::bigint, (floor(b / {DAY}::double))::bigint + 1)) * {DAY} as us from ends), back as (
 select g.user_id, g.us, e.us as t0, e.x as x0, e.y as y0, e.z as z0, e.w as w0 from grid g asof left join p e on g.user_id = e.user_id and g.us >= e.us), s as (
 select b.*, e.us as t1, e.x as x1, e.y as y1, e.z as z1, e.w as w1, (b.us - b.t0)::double / (e.us - b.t0) as f, b.x0 * e.x + b.y0 * e.y + b.z0 * e.z + b.w0 * e.w as d
 from back b asof left join p e on b.user_id = e.user_id and b.us < e.us), a as (
 select *, case when d < 0 then -1.0 else 1.0 end as sg, least(1.0, abs(d)) as c from s), w as (
 select *, case when c > 1 - 1e-12 then 1 - f else sin((1 - f) * acos(c)) / nullif(sin(acos(c)), 0) end as k0,
 case when c > 1 - 1e-12 then f else sin(f * acos(c)) / nullif(sin(acos(c)), 0) end as k1 from a), m as (
 select user_id, us, k0 * x0 + sg * k1 * x1 as x, k0 * y0 + sg * k1 * y1 as y, k0 * z0 + sg * k1 * z1 as z, k0 * w0 + sg * k1 * w1 as w from w)
select user_id, us, round(x / sqrt(x*x + y*y + z*z + w*w), 6) as x, round(y / sqrt(x*x + y*y + z*z + w*w), 6) as y, round(z / sqrt(x*x + y*y + z*z + w*w), 6) as z, round(w / sqrt(x*x + y*y + z*z + w*w), 6) as w from m"""


def sign_continuous(spark, d) -> DataFrame:
    p = _poses(events(spark, d))
    out = S.sign_flips(p, SERIES, Q.dot(F.col("q"), F.lag("q").over(SERIES.window)))
    return out.select("event_id", "sign", F.round(F.col("sign") * F.col("q.w"), 6).alias("w"))


SIGN = f"""with {EVENTS}, {_POSES}, l as (select *, x * lag(x) over v + y * lag(y) over v + z * lag(z) over v + w * lag(w) over v as d from p window v as (partition by user_id order by us, event_id)), r as (
 select *, count(*) filter (d = 0) over (partition by user_id order by us, event_id rows unbounded preceding) as run from l), s as (
 select *, case when sum(case when d < 0 then 1 else 0 end) over (partition by user_id, run order by us, event_id rows unbounded preceding) % 2 = 0 then 1 else -1 end as sign from r)
select event_id, sign::int as sign, round(sign * w, 6) as w from s"""


def finite_difference_rate(spark, d) -> DataFrame:
    p = _poses(events(spark, d))
    ahead = p.withColumns({"q1": F.lead("q").over(SERIES.window), "us1": F.lead("us").over(SERIES.window)}).where("q1 is not null")
    v = Q.rotation_vector(Q.multiply(Q.inverse(F.col("q")), F.col("q1")))
    seconds = (F.col("us1") - F.col("us")) / F.lit(3.6e9)
    out = ahead.withColumns({"v": v, "hours": seconds})
    return out.select("event_id", ((F.col("us") + F.col("us1")) / 2).alias("mid_us"), *[(F.round(F.col(f"v.{c}") / F.col("hours"), 4) + 0.0).alias(f"r{c}") for c in "xyz"])


RATE = f"""with {EVENTS}, {_POSES}, n as (select *, lead(us) over v as us1, lead(x) over v as bx, lead(y) over v as b_y, lead(z) over v as bz, lead(w) over v as bw from p window v as (partition by user_id order by us, event_id)), q as (
 select event_id, us, us1, w * bx - x * bw - y * bz + z * b_y as qx, w * b_y + x * bz - y * bw - z * bx as qy, w * bz - x * b_y + y * bx - z * bw as qz, w * bw + x * bx + y * b_y + z * bz as qw from n where us1 is not null), f as (
 select *, sqrt(qx * qx + qy * qy + qz * qz) as s, case when qw < 0 then -1.0 else 1.0 end as g, (us1 - us) / 3.6e9::double as hours from q), k as (
 select *, case when s < 1e-12 then 2.0 else 2 * atan2(s, g * qw) / nullif(s, 0) end as c from f)
select event_id, (us + us1) / 2 as mid_us, round(c * g * qx / hours, 4) + 0.0::double as rx, round(c * g * qy / hours, 4) + 0.0::double as ry, round(c * g * qz / hours, 4) + 0.0::double as rz from k"""


def measured_pair_acceleration(spark, d) -> DataFrame:
    """Differences of neighbours that are both measured; a row between them that is not is never bridged."""
    e = events(spark, d).withColumn("rate", F.when(F.col("event_type") != "error", F.col("value")))
    step = F.abs(F.col("rate") - F.lag("rate").over(SERIES.window))
    return e.withColumn("step", step).groupBy("user_id").agg(F.count("rate").alias("measured"), F.count("step").alias("pairs"), F.round(F.percentile("step", F.lit(0.95)), 6).alias("p95"))


ACCELERATION = f"""with {EVENTS}, r as (select *, case when event_type <> 'error' then value end as rate from ev), s as (select user_id, rate, abs(rate - lag(rate) over (partition by user_id order by us, event_id)) as step from r)
select user_id, count(rate) as measured, count(step) as pairs, round(quantile_cont(step, 0.95), 6) as p95 from s group by user_id"""


def second_difference_p95(spark, d) -> DataFrame:
    w = SERIES.window
    bend = F.abs(F.col("value") - 2 * F.lag("value").over(w) + F.lag("value", 2).over(w))
    return events(spark, d).withColumn("bend", bend).groupBy("user_id").agg(F.count("bend").alias("n"), F.round(F.percentile("bend", F.lit(0.95)), 6).alias("p95"))


SECOND = f"""with {EVENTS}, s as (select user_id, abs(value - 2 * lag(value) over w + lag(value, 2) over w) as bend from ev window w as (partition by user_id order by us, event_id))
select user_id, count(bend) as n, round(quantile_cont(bend, 0.95), 6) as p95 from s group by user_id"""

#: The decaying state at 30 rows a second with a time constant of a quarter second.
DECAY = math.exp(-1 / (30 * 0.25))


def ema_state(spark, d) -> DataFrame:
    out = S.ema(events(spark, d), SERIES, F.col("value"), F.lit(True), 1 - DECAY, DECAY)
    return out.select("event_id", F.round("state", 6).alias("state"))


EMA = f"""with {EVENTS}, l as (select user_id, list(value order by us, event_id) as v, list(event_id order by us, event_id) as ids from ev group by user_id), f as (
 select ids, v, range(1, len(v) + 1) as ks from l), u as (select ids[k] as event_id, list_reduce(v[1:k], lambda a, x: a + {1 - DECAY!r}::double * (x - a)) as state from (select ids, v, unnest(ks) as k from f))
select event_id, round(state, 6) as state from u"""


def ema_clipped_decay(spark, d) -> DataFrame:
    out = S.ema(events(spark, d), SERIES, F.col("value"), F.col("event_type") != "error", 1 - DECAY, DECAY, 1.0)
    return out.select("event_id", F.round("state", 6).alias("state"))


EMA_CLIPPED = f"""with recursive {EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) as k from ev), r as (
 select user_id, event_id, k, case when event_type <> 'error' then value end as state from n where k = 1 union all
 select n.user_id, n.event_id, n.k, case when n.event_type <> 'error' then case when r.state is null then n.value else r.state + greatest(-1.0, least(1.0, {1 - DECAY!r}::double * (n.value - r.state))) end else r.state * {DECAY!r}::double end
 from r join n on n.user_id = r.user_id and n.k = r.k + 1)
select event_id, round(state, 6) as state from r"""


def train_holdout_blocks(spark, d) -> DataFrame:
    first = F.min("us").over(W.partitionBy("user_id"))
    e = events(spark, d).withColumn("rel", F.col("us") - first)
    e = e.withColumn("training", S.alternating_blocks(F.col("rel"), 36_000))
    return e.groupBy("user_id", "training").agg(F.count("*").alias("n"), F.min("rel").alias("first_us"), F.max("rel").alias("last_us"))


TRAIN = f"""with {EVENTS}, r as (select user_id, us - min(us) over (partition by user_id) as rel from ev)
select user_id, (rel // 36000000000) % 2 = 0 as training, count(*) as n, min(rel) as first_us, max(rel) as last_us from r group by 1, 2"""


def four_contiguous_blocks(spark, d) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / DAY))
    return S.contiguous_blocks(e, "user_id", "day").groupBy("user_id", "block", "training").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


FOUR = f"""with {EVENTS}, e as (select *, us // {DAY} as day from ev), g as (select user_id, day, row_number() over (partition by user_id order by day) - 1 as r, count(*) over (partition by user_id) as c from (select distinct user_id, day from e)), b as (
 select user_id, day, least(3, r * 4 // c) as block from g)
select user_id, block::bigint as block, block % 2 = 0 as training, count(*) as n, count(distinct day) as days from e join b using (user_id, day) group by user_id, block"""


def frame_clock_midpoint(spark, d) -> DataFrame:
    """Ordinals count from the first purchase of a source; its clock against nominal days."""
    e = events(spark, d).withColumn("k", F.row_number().over(SERIES.window))
    zero = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("k").alias("zero"), F.min("us").alias("zero_us"))
    out = e.join(zero, "user_id").withColumn("ordinal", F.col("k") - F.col("zero")).where("ordinal >= 0")
    return out.select("event_id", "ordinal", (F.col("us") - F.col("zero_us") - F.col("ordinal") * DAY).alias("residual_us"))


FRAME_CLOCK = f"""with {EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) as k from ev), z as (select user_id, min(k) as zero, min(us) as zero_us from n where event_type = 'purchase' group by user_id)
select event_id, (k - zero)::int as ordinal, us - zero_us - (k - zero) * {DAY} as residual_us from n join z using (user_id) where k >= zero"""


def frame_offset_pairing(spark, d) -> DataFrame:
    """Each source's rows with the rows three later."""
    e = events(spark, d).withColumn("frame", F.row_number().over(SERIES.window))
    a = e.select("user_id", "frame", F.col("value").alias("candidate"))
    b = e.select("user_id", (F.col("frame") - 3).alias("frame"), F.col("value").alias("reference"))
    return a.join(b, ["user_id", "frame"]).groupBy("user_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("candidate") - F.col("reference"))), 6).alias("mean_difference"))


PAIRING = f"""with {EVENTS}, n as (select user_id, value, row_number() over (partition by user_id order by us, event_id) as frame from ev)
select a.user_id, count(*) as pairs, round(avg(abs(a.value - b.value)), 6) as mean_difference from n a join n b on a.user_id = b.user_id and b.frame = a.frame + 3 group by a.user_id"""


def grid_shift_argmin(spark, d) -> DataFrame:
    """Rows against themselves two rows later: the shift is found."""
    e = events(spark, d).withColumn("k", F.row_number().over(SERIES.window)).withColumn("reference", F.lag("value", 2).over(SERIES.window))
    return matching.grid_shift(e.select("user_id", "k", "value", "reference"), "user_id", "k", "value", range(-4, 5))


GRID_SHIFT = f"""with {EVENTS}, n as (select user_id, value, row_number() over w as k, lag(value, 2) over w as ref from ev window w as (partition by user_id order by us, event_id)), c as (
 select a.user_id, s.shift, round(avg((a.value - b.ref) ** 2), 9) as cost, count(*) as n from n a cross join (select unnest(range(-4, 5)) as shift) s join n b on b.user_id = a.user_id and b.k = a.k + s.shift group by a.user_id, s.shift), m as (
 select user_id, min(cost) as cost, max(n) as n from c group by user_id)
select m.user_id, min(c.shift)::int as shift, m.cost, m.n from m join c on c.user_id = m.user_id and c.cost is not distinct from m.cost group by m.user_id, m.cost, m.n"""



def track_segments_stream(spark, d) -> DataFrame:
    """The segments again, from a stateful stream over the events' file."""

    def transform(stream: DataFrame) -> DataFrame:
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        rows = stream.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), us.alias("us"), "value", F.expr(VOID).alias("void"), F.expr(INVALID).alias("invalid"))
        return tracks.segments(rows, DAY)

    points = replay(table(spark, d, "events"), d, "events.parquet", transform).where("status = 'ok'")
    out = points.groupBy(F.col("source").alias("user_id"), "segment").agg(
        F.count("*").alias("points"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
    number = F.row_number().over(W.partitionBy("user_id").orderBy("segment")).cast("long")
    return out.select("user_id", number.alias("segment_id"), "points", "first_us", "last_us", ((F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("duration_s"), "min_value", "max_value")


def rate_fit(spark, d) -> DataFrame:
    """Directions against themselves turned by 0.25 about z, shifted by two rows and with a bias: the fit finds all three again."""
    e = table(spark, d, "embeddings")
    parts = [F.element_at("embedding", k).cast("double") for k in (1, 2, 3)]
    a = e.select("vec_id", *[p.alias(f"a{k}") for k, p in enumerate(parts)])
    c, s = math.cos(0.25), math.sin(0.25)
    b = a.select((F.col("vec_id") - 2).alias("at"), (F.col("a0") * c - F.col("a1") * s + 0.01).alias("b0"), (F.col("a0") * s + F.col("a1") * c - 0.02).alias("b1"), (F.col("a2") + 0.03).alias("b2"))
    grid = a.select("vec_id", F.explode(F.array(*[F.lit(k) for k in range(-4, 5)])).alias("shift"), "a0", "a1", "a2").withColumn("at", F.col("vec_id") - F.col("shift"))
    pairs = grid.join(b, "at").select(F.lit("recording").alias("source"), "shift", *[f"{x}{k}" for x in "ab" for k in range(3)])
    fit = motion.fit_rates(pairs)
    out = [(F.round(F.element_at("m", k + 1), 6) + 0.0).alias(f"m{k // 3}{k % 3}") for k in range(9)] + [(F.round(F.element_at("bias", k + 1), 6) + 0.0).alias(f"bias{k}") for k in range(3)]
    return fit.select("source", "shift", *out, (F.round("rms", 6) < 1e-5).alias("exact"))


RATE_FIT = """select 'recording' as source, 2 as shift, round(cos(0.25::double), 6) as m00, round(sin(0.25::double), 6) as m01, 0.0::double as m02, round(-sin(0.25::double), 6) as m10, round(cos(0.25::double), 6) as m11, 0.0::double as m12,
 0.0::double as m20, 0.0::double as m21, 1.0::double as m22, 0.01::double as bias0, -0.02::double as bias1, 0.03::double as bias2, true as exact"""

QUERIES = {
    "track_segments_stream": track_segments_stream, "rate_fit": rate_fit,
    "track_segments": track_segments, "track_segment_summary": track_segment_summary, "track_void_invalid_counts": track_void_invalid_counts, "monotonic_summary": monotonic_summary,
    "cadence_summary": cadence_summary, "reading_summary": reading_summary, "span_limited_gaps": span_limited_gaps, "asof_backward": asof_backward,
    "asof_linear_interpolate": asof_linear_interpolate, "interpolate_gap_guard": interpolate_gap_guard, "slerp_resample": slerp_resample, "sign_continuous": sign_continuous,
    "finite_difference_rate": finite_difference_rate, "measured_pair_acceleration": measured_pair_acceleration, "second_difference_p95": second_difference_p95, "ema_state": ema_state,
    "ema_clipped_decay": ema_clipped_decay, "train_holdout_blocks": train_holdout_blocks, "four_contiguous_blocks": four_contiguous_blocks, "frame_clock_midpoint": frame_clock_midpoint,
    "frame_offset_pairing": frame_offset_pairing, "grid_shift_argmin": grid_shift_argmin,
}
ORACLES = {
    "track_segments_stream": TRACK_SEGMENTS, "rate_fit": RATE_FIT,
    "track_segments": TRACK_SEGMENTS, "track_segment_summary": TRACK_SEGMENT_SUMMARY, "track_void_invalid_counts": TRACK_VOID, "monotonic_summary": MONOTONIC,
    "cadence_summary": CADENCE, "reading_summary": READING, "span_limited_gaps": SPAN_GAPS, "asof_backward": ASOF,
    "asof_linear_interpolate": ASOF_LINEAR, "interpolate_gap_guard": GAP_GUARD, "slerp_resample": SLERP, "sign_continuous": SIGN,
    "finite_difference_rate": RATE, "measured_pair_acceleration": ACCELERATION, "second_difference_p95": SECOND, "ema_state": EMA,
    "ema_clipped_decay": EMA_CLIPPED, "train_holdout_blocks": TRAIN, "four_contiguous_blocks": FOUR, "frame_clock_midpoint": FRAME_CLOCK,
    "frame_offset_pairing": PAIRING, "grid_shift_argmin": GRID_SHIFT,
}
