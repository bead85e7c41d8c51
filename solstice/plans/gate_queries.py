"""Gates, reports, selections and text functions on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lens as L
from ..functions import quaternion as Q
from ..operators import calibration, frames, gates, matching, raster, recurrence
from ..operators import series as S
from .tables import DAY, EVENTS, SERIES, events, table

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


_MODES = {"1": "standard-video", "2": "timelapse", "3": "hdr-photo", "4": "unspecified", "5": "starlapse"}


@query("""with m as (select *, case left(o_orderpriority, 1) when '1' then 'standard-video' when '2' then 'timelapse' when '3' then 'hdr-photo' when '4' then 'unspecified' when '5' then 'starlapse' end as mode from orders)
select o_orderkey, case when mode in ('standard-video', 'unspecified') then null when mode = 'timelapse' then 'retimed' when mode = 'hdr-photo' then 'grouped' else 'not qualified' end as refusal,
 o_orderkey % 5 = 4 or o_custkey % 7 not in (0, 1) as coloured from m""")
def mode_requirement(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    mode = F.create_map(*[F.lit(x) for pair in _MODES.items() for x in pair])[F.left("o_orderpriority", F.lit(1))]
    coloured = gates.colour_refusal((F.col("o_orderkey") % 5 == 4).cast("int"), F.col("o_custkey") % 7, F.lit(0), F.lit(None).cast("int"))
    return o.select("o_orderkey", gates.mode_refusal(mode, "video").alias("refusal"), coloured.alias("coloured"))


@query("""with p as (select c_custkey as profile, c_nationkey % 6 as schema, case when c_custkey % 4 = 0 then 'exposure-midpoint-v1' when c_custkey % 4 = 1 then 'nominal' end as clock, c_custkey % 9 <> 0 as camera, c_custkey % 5 <> 0 as lower, c_custkey % 11 = 0 as flip, c_custkey % 3 = 0 as other from customer)
select profile, 'schema' as rule from p where schema not in (1, 2, 3, 4)
union all select profile, 'frame clock' from p where (schema = 1 and coalesce(clock, 'nominal') <> 'nominal') or (schema = 2 and coalesce(clock, 'nominal') <> 'exposure-midpoint-v1')
union all select profile, 'camera' from p where not camera union all select profile, 'fingerprint' from p where not lower
union all select profile, 'rotation' from p where flip union all select profile, 'recording' from p where other or not lower""")
def calibration_contract(spark, d) -> DataFrame:
    """Customers as calibration profiles with various faults."""
    key, digest = F.col("c_custkey"), F.sha2("c_name", 256)
    p = table(spark, d, "customer").select(
        key.alias("profile"), (F.col("c_nationkey") % 6).alias("schema"), F.when(key % 4 == 0, "exposure-midpoint-v1").when(key % 4 == 1, "nominal").alias("frame_clock"), F.when(key % 9 == 0, "").otherwise("one").alias("camera"),
        F.when(key % 5 == 0, F.concat(F.lit("G"), F.substring(digest, 2, 63))).otherwise(digest).alias("fingerprint"), F.when(key % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(digest).alias("recording_fingerprint"),
        F.array(*[F.lit(float(i == j)) if i < 2 or i != j else F.when(key % 11 == 0, -1.0).otherwise(1.0) for i in range(3) for j in range(3)]).alias("rotation"),
    )
    return gates.calibration_violations(p)


@query("""with p as (select p_partkey as profile, p_size / 500::double as b, (p_partkey % 30 - 15) / 200::double as shift from part)
select profile, 'schema' as rule from p where profile % 13 = 0 union all select profile, 'recording' from p where profile % 17 = 0
union all select profile, 'bias' from p where b > 5 * pi() / 180 union all select profile, 'shift' from p where abs(shift) > 0.06::double""")
def gyro_profile_contract(spark, d) -> DataFrame:
    """Parts as gyro profiles."""
    key, zero = F.col("p_partkey"), F.lit(0.0)
    return gates.gyro_violations(table(spark, d, "part").select(
        key.alias("profile"), F.when(key % 13 == 0, 2).otherwise(1).alias("schema"), F.lit("rigid-gyro").alias("kind"), F.lit("a").alias("fingerprint"), F.when(key % 17 == 0, "b").otherwise("a").alias("recording_fingerprint"),
        F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)]).alias("rotation"), F.array(zero, F.col("p_size") / 500, zero).alias("bias"), ((key % 30 - 15) / 200).alias("shift"),
    ))


@query("""select l_orderkey * 10 + l_linenumber as line, l_returnflag <> 'A' and abs(l_discount / 10 - 0.005::double) <= 0.01::double * 0.005::double + 1e-6 as same_timing,
 l_quantity - l_tax / 2 >= 3 and l_quantity + l_discount * 10 + l_tax / 2 <= 45 as covered from lineitem""")
def timing_and_coverage(spark, d) -> DataFrame:
    c = F.col
    rate = F.when(c("l_returnflag") != "A", "30").otherwise("60")
    same = gates.same_timing(rate, F.lit("30"), c("l_discount") / 10, F.lit(0.005))
    inside = gates.covered(c("l_quantity"), c("l_quantity") + c("l_discount") * 10, F.lit(3.0), F.lit(45.0), c("l_tax"))
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("line"), same.alias("same_timing"), inside.alias("covered"))


_QUATERNIONS = """q as (select vec_id as track, list_transform(range(0, 16), lambda k: list_transform(range(1, 5), lambda j: abs(embedding[4 * k + j]::double) + case when vec_id % 3 = 0 then 0.0 when j = 4 then 0.0 when vec_id % 3 = 1 and k = 7 then -9.0 else 0.0 end)) as v from embeddings), u as (
 select track, list_transform(v, lambda x: list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z))) * case when track % 5 = 0 then 1.01::double else 1.0::double end)) as r from q)"""


@query(f"""with {_QUATERNIONS} select track, 'unit' as rule from u where track % 5 = 0
union all select track, 'continuous' from u where len(list_filter(range(1, 16), lambda k: list_dot_product(r[k], r[k + 1]) <= 0)) > 0""")
def row_track_contract(spark, d) -> DataFrame:
    """Sixteen quaternions from each vector as a row track; some are too long, some turn over."""
    at = lambda k, j: F.abs(F.element_at("embedding", 4 * k + j + 1).cast("double")) + F.when((F.col("vec_id") % 3 == 1) & F.lit(k == 7 and j < 3), -9.0).otherwise(0.0)
    rows = []
    for k in range(16):
        parts = [at(k, j) for j in range(4)]
        scale = F.when(F.col("vec_id") % 5 == 0, 1.01).otherwise(1.0) / F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
        rows.append(F.struct(*[(p * scale).alias(c) for p, c in zip(parts, "xyzw", strict=True)]))
    return gates.row_track_violations(table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.array(*rows).alias("rows")))


_FRAMES = f"{EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as frame from ev)"


def _frames(spark, d) -> DataFrame:
    return events(spark, d).withColumn("frame", F.row_number().over(SERIES.window) - 1)


@query(f"with {_FRAMES} select event_id, frame from n where frame >= 4 and frame < 44 and frame % 3 = 0")
def frame_selection(spark, d) -> DataFrame:
    return gates.frame_range(_frames(spark, d), 4, 40, every=3).select("event_id", F.col("frame").cast("long").alias("frame"))


@query("""with l as (select p_partkey as lens, p_partkey % 4 as guard, p_partkey % 6 = 0 as edited, 3000 as height, 3000 - p_partkey % 2 as src, 3000 - p_size * 3 as dst, 2900 - p_size as width from part)
select lens, 'guards off' as rule from l where guard <> 3 union all select lens, 'unedited' from l where edited union all select lens, 'square' from l where src <> height
union all select lens, 'width' from l where not (width >= 32 and width <= dst and dst <= height) union all select lens, 'centred' from l where (height - dst) % 2 <> 0""")
def crop_contract(spark, d) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    src, dst = 3000 - key % 2, 3000 - size * 3
    return gates.crop_violations(table(spark, d, "part").select(key.alias("lens"), (key % 4).alias("guard"), (key % 6 == 0).alias("edited"), F.lit(3000).alias("height"), src.alias("src_width"), F.lit(3000).cast("long").alias("_h"), src.alias("src_height"), dst.alias("dst_width"), dst.alias("dst_height"), (2900 - size).alias("width")))


@query("""with p as (select conv_id, turn, case when turn % 3 = 0 then 'needs_review' when turn % 3 = 1 then 'reviewed' else 'new' end as status, case when turn % 2 = 1 then role end as notes, text from conversations), a as (
 select *, status = 'needs_review' and length(trim(text)) between 8 and 4000 as good from p)
select conv_id, turn, case when good then 'reviewed' else status end as status, case when good then trim(text) else notes end as notes, case when good then sha256(role_doc) end as fingerprint from (select *, conv_id || ':' || turn as role_doc from a)""")
def proposal_approval(spark, d) -> DataFrame:
    """Turns of conversations as proposals; their texts as the reviews."""
    c = table(spark, d, "conversations").withColumn("proposal", F.struct("conv_id", "turn"))
    status = F.when(F.col("turn") % 3 == 0, "needs_review").when(F.col("turn") % 3 == 1, "reviewed").otherwise("new")
    p = c.select("proposal", status.alias("status"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("notes"), F.concat_ws(":", "conv_id", "turn").alias("document"))
    return gates.approve(p, c.select("proposal", "text")).select("proposal.conv_id", "proposal.turn", "status", "notes", "fingerprint")


@query("""with p as (select conv_id, turn, case when turn % 3 = 0 then 'needs_review' when turn % 3 = 1 then 'reviewed' else 'new' end as status, case when turn % 2 = 1 then role end as notes from conversations)
select conv_id, turn, 'status' as rule from p where status = 'new' union all select conv_id, turn, 'reviewed' from p where status = 'needs_review' union all select conv_id, turn, 'notes' from p where status = 'reviewed' and notes is null""")
def review_contract(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("proposal", F.struct("conv_id", "turn"))
    status = F.when(F.col("turn") % 3 == 0, "needs_review").when(F.col("turn") % 3 == 1, "reviewed").otherwise("new")
    found = gates.review_violations(c.select("proposal", status.alias("status"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("notes")))
    return found.select("proposal.conv_id", "proposal.turn", "rule")


@query("select c_custkey, c_nationkey, 1 as schema, 'experimental' as quality_status from customer where c_custkey % 4 <> 0 and c_custkey % 5 not in (2, 3)")
def profile_migration(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    old = table(spark, d, "customer").withColumns({"frame_clock": F.when(key % 4 == 0, "exposure-midpoint-v1").when(key % 4 == 1, "nominal"), "schema": F.when(key % 5 > 0, key % 5)})
    return gates.migrated(old, ["c_custkey", "c_nationkey"])


@query("""select doc_id, case when doc_id % 11 <> 3 then sha256(text) end as before, case when doc_id % 13 <> 5 then sha256(text || case when doc_id % 7 = 0 then 'x' else '' end) end as after from documents
 where (doc_id % 11 = 3) <> (doc_id % 13 = 5) or (doc_id % 7 = 0 and doc_id % 11 <> 3 and doc_id % 13 <> 5)""")
def changed_sources(spark, d) -> DataFrame:
    """Documents and their later state: some edited, some gone, some new."""
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 11 <> 3").select("doc_id", F.sha2("text", 256).alias("identity"))
    after = docs.where("doc_id % 13 <> 5").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")), 256).alias("identity"))
    return gates.changed(before, after, "doc_id", "identity")


@query("""select o_orderkey, case when p.c_custkey is null then 'missing' when o_orderkey % 4 = c_custkey % 4 then 'bound' else 'foreign' end as status
 from orders left join (select * from customer where c_custkey % 3 <> 0) p on o_custkey = c_custkey""")
def fingerprint_binding(spark, d) -> DataFrame:
    """Orders as recordings of customers' profiles."""
    profiles = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("customer"), (F.col("c_custkey") % 4).cast("string").alias("fingerprint"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 4).cast("string").alias("fingerprint"))
    return gates.bound(profiles, orders, "customer", "fingerprint").select("o_orderkey", "status")


@query(f"""with {EVENTS}, n as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by us, event_id) - 1 as frame from ev where event_type in ('click', 'error')), c as (
 select user_id, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'error') as errors from n group by user_id)
select a.user_id, a.frame, a.value as first, b.value as second, 'paired' as status from n a join n b using (user_id, frame) join c using (user_id) where clicks = errors and a.event_type = 'click' and b.event_type = 'error'
union all select user_id, -1, null, null, case when clicks = 0 or errors = 0 then 'one track' else 'other length' end from c where clicks <> errors""")
def paired_lens_frames(spark, d) -> DataFrame:
    """All clicks and errors of a user as the two tracks of a recording; frame -1 tells why a user has no pairs."""
    e = recurrence.numbered(events(spark, d).where(F.col("event_type").isin("click", "error")).withColumn("track", F.struct("user_id", "event_type")), "track", F.floor(F.col("us") / DAY), ["us", "event_id"])
    tracks = [e.where(F.col("event_type") == kind).select("user_id", F.col("k").alias("frame"), "value") for kind in ("click", "error")]
    return gates.paired_or_why(*tracks, "user_id", "frame", "value").withColumn("frame", F.coalesce("frame", F.lit(-1).cast("long")))


@query("""select l_orderkey * 10 + l_linenumber as track from lineitem where sqrt((l_discount * 5) ** 2 + (l_tax * 5) ** 2) < 0.6::double and l_quantity * 2 >= 2 and l_quantity * 2 < 88 and l_partkey % 100 >= 2 and l_partkey % 100 < 88""")
def round_trip_tracks(spark, d) -> DataFrame:
    c = F.col
    t = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("track"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (c("l_quantity") * 2).alias("there_x"), (c("l_partkey") % 100).cast("double").alias("there_y"), (c("l_discount") * 5).alias("back_x"), (c("l_tax") * 5).alias("back_y"))
    return gates.round_trips(t, 90, 90).select("track")


@query(f"""with {EVENTS}, n as (select *, row_number() over w - 1 as k, us - lag(us) over w as step from ev window w as (partition by user_id order by us, event_id)), o as (
 select user_id, min(us) filter (event_type = 'purchase') as origin, count(*) // 2 as frames from ev group by user_id having min(us) filter (event_type = 'purchase') is not null), r as (
 select n.*, origin, frames, min(k) filter (us = origin) over (partition by user_id) as zero from n join o using (user_id)), m as (select *, k - zero >= 0 and k - zero < frames as mapped from r)
select user_id, min(zero)::bigint as first_record, count(*) filter (mapped) as mapped, round(min(case when mapped then (us - origin) / 1e6 - (k - zero) * 86400.0 end), 3) as least_residual, round(max(case when mapped then (us - origin) / 1e6 - (k - zero) * 86400.0 end), 3) as largest_residual,
 case when count(*) filter (us = origin) <> 1 then 'origin' when count(*) filter (mapped) < min(frames) then 'coverage' when count(*) filter (step <= 0) > 0 then 'order' when count(*) filter (mapped and k > zero and step > 1.1 * 86400e6) > 0 then 'cadence' else 'ok' end as status
 from m group by user_id""")
def exposure_clock(spark, d) -> DataFrame:
    """Events as exposures: a frame a day from a user's first purchase on."""
    e = events(spark, d)
    video = e.groupBy(F.col("user_id").alias("source")).agg(F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("origin_us"), F.floor(F.count("*") / 2).alias("frames")).where("origin_us is not null").withColumn("fps", F.lit(1 / 86400))
    rows = e.select(F.col("user_id").alias("source"), (F.row_number().over(SERIES.window) - 1).cast("long").alias("sample"), "us", F.lit(1.0).alias("seconds"))
    out = gates.clock_report(rows, video).withColumnRenamed("source", "user_id")
    return out.withColumns({c: F.round(c, 3) for c in ("least_residual", "largest_residual")})


@query(f"""with {EVENTS}, s as (select user_id, us / 1e6::double as t, us / 1e6::double - lag(us / 1e6::double) over (partition by user_id order by us, event_id) as step, value as x, value % 7 as y from ev)
select user_id, count(*) as samples, min(t) as first_seconds, max(t) as last_seconds, count(*) filter (step > 0.25::double) as gaps, min(x) as least_fov_x, max(x) as largest_fov_x, min(y) as least_fov_y, max(y) as largest_fov_y from s group by user_id""")
def view_summary(spark, d) -> DataFrame:
    e = events(spark, d)
    return gates.view_summary(e.select(F.col("user_id").alias("source"), (F.row_number().over(SERIES.window)).alias("sample"), (F.col("us") / 1e6).alias("t"), F.col("value").alias("fov_x"), (F.col("value") % 7).alias("fov_y"))).withColumnRenamed("source", "user_id")


@query("select label, round(degrees(sqrt(avg(embedding[1]::double ** 2 + embedding[2]::double ** 2 + embedding[3]::double ** 2))), 6) as rms_degrees from embeddings group by label")
def vector_rms(spark, d) -> DataFrame:
    x, y, z = (F.element_at("embedding", k).cast("double") for k in (1, 2, 3))
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(gates.vector_rms(x, y, z), 6).alias("rms_degrees"))


@query("""with a as (select o_custkey % 4 as split, degrees(2 * asin(least(1.0::double, (o_orderkey % 1000) / 400::double / 2))) as angle from orders)
select split, count(*) as n, round(quantile_cont(angle, 0.5), 6) as median_degrees, round(quantile_cont(angle, 0.95), 6) as p95_degrees from a group by split""")
def temporal_block_scores(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("split"), (F.col("o_orderkey") % 1000 / 400).alias("length"))
    out = gates.block_scores(o, "split", "length")
    return out.withColumns({c: F.round(c, 6) for c in ("median_degrees", "p95_degrees")})


@query("""with f as (select l_suppkey as source, case when l_quantity > 10 then l_quantity - 10 else 0 end as trusted, l_linenumber * 8 as middle, l_discount as b, l_tax as a from lineitem)
select source, count(*) as frames, round(avg(trusted / greatest(1, middle)), 6) as confident, count(*) filter (trusted > 0) as measured, round(avg(b) filter (trusted > 0), 6) as residual_before, round(avg(a) filter (trusted > 0), 6) as residual_after, round(max(1 - trusted / greatest(1, middle)), 6) as uncovered from f group by source""")
def seam_diagnostics(spark, d) -> DataFrame:
    c = F.col
    f = table(spark, d, "lineitem").select(c("l_suppkey").alias("source"), F.when(c("l_quantity") > 10, c("l_quantity") - 10).otherwise(0.0).alias("trusted"), (c("l_linenumber") * 8).alias("middle"), c("l_discount").alias("before"), c("l_tax").alias("after"))
    out = gates.seam_report(f, "source")
    return out.withColumns({x: F.round(x, 6) for x in ("confident", "residual_before", "residual_after", "uncovered")})


@query(f"""with {EVENTS}, p as (select user_id, event_type, value / 300 as v, (value + event_id % 90) / 300 as o from ev), m as (select user_id, event_type, count(*) as n, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.1) as dark from p group by 1, 2)
select user_id, event_type, n, round(median, 6) as median, round(dark, 6) as dark, round(quantile_cont(abs(v - median), 0.5), 6) as variation, round(quantile_cont(o - v, 0.5), 6) as excess, round(avg((o - v > 0.06::double)::int), 6) as persistence from p join m using (user_id, event_type) group by user_id, event_type, n, median, dark""")
def obstruction_statistics(spark, d) -> DataFrame:
    """Users and types as pixels of a lens over time."""
    e = events(spark, d).select("user_id", "event_type", (F.col("value") / 300).alias("value"), ((F.col("value") + F.col("event_id") % 90) / 300).alias("other"))
    out = gates.obstruction_statistics(e, "user_id", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "dark", "variation", "excess", "persistence")})


@query("""with f as (select p_brand as fits, p_partkey as id, p_size * 2 as inliers, p_partkey % 120 as valid, p_retailprice / 1000 as p95 from part), g as (select *, radians((id % 40) / 10::double) as turn from f where inliers >= 30 and 2 * inliers >= valid and p95 <= 1.2::double), p as (
 select a.fits, a.id, round(abs(degrees(a.turn - b.turn)), 6) as d from g a join g b on a.fits = b.fits), s as (select fits, id, quantile_cont(d, 0.5) as m, count(*) filter (d <= 0.75::double) as consistent, count(*) as n from p group by fits, id), r as (select *, row_number() over (partition by fits order by m, id) as k from s)
select fits, id, round(m, 6) as median_distance, consistent, n, consistent >= greatest(2, case when n > 1 then n // 2 + 1 else 1 end) as accepted from r where k = 1""")
def overlap_consensus(spark, d) -> DataFrame:
    """Parts as fits of a brand's frames: the good ones vote by the angle between their turns."""
    c = F.col
    f = table(spark, d, "part").select(c("p_brand").alias("fits"), c("p_partkey").alias("id"), (c("p_size") * 2).alias("inliers"), (c("p_partkey") % 120).alias("valid"), (c("p_retailprice") / 1000).alias("p95"))
    good = gates.overlap_consensus_input(f).withColumn("turn", F.radians(c("id") % 40 / 10))
    out = matching.medoid(good.select("fits", "id", "turn"), "fits", "id", lambda a, b: F.round(F.abs(F.degrees(F.col("a.turn") - F.col("b.turn"))), 6), 0.75, 2)
    return out.withColumn("median_distance", F.round("median_distance", 6))


@query("""with v as (select o_orderkey as source, o_custkey % 300 as f, 200 + o_custkey % 100 as n from orders), b as (select *, list_distinct([least(n - 1, f), least(n - 1, f + 30), least(n - 1, f + 90)]) as p from v), c as (
 select *, case when len(p) < 3 then list_distinct(p || [greatest(0, f - 30)]) else p end as q from b), e as (select *, case when len(q) < 3 then list_distinct(q || [greatest(0, f - 90)]) else q end as r from c)
select source, unnest(case when len(r) < 3 then list_distinct(r || [0]) else r end) as frame from e""")
def planned_frames(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), (F.col("o_custkey") % 300).alias("first_frame"), (200 + F.col("o_custkey") % 100).alias("frames"), F.lit(29.97).alias("fps"))
    return gates.planned_frames(o).select("source", F.col("frame").cast("long").alias("frame"))


@query(f"""with {EVENTS}, n as (select event_id, row_number() over (partition by user_id order by us, event_id) - 1 as i, greatest(1, count(*) over (partition by user_id) // 12) as k from ev)
select event_id from n where i % k = 0""")
def even_thinning(spark, d) -> DataFrame:
    e = events(spark, d).withColumn("clock", F.struct("us", "event_id"))
    return gates.thinned(e, "user_id", "clock", 12).select("event_id")


@query(f"with {EVENTS}, n as (select event_id, row_number() over (partition by user_id order by us, event_id) as i from ev) select event_id from n where i <= 7")
def first_samples(spark, d) -> DataFrame:
    return gates.first_rows(events(spark, d).withColumn("clock", F.struct("us", "event_id")), "user_id", "clock", 7).select("event_id")


@query("select l_orderkey, to_json(list_sort(list_distinct(list(l_quantity::bigint)))) as frames, count(*) as n from lineitem group by l_orderkey")
def sample_lists(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(gates.sample_list(F.collect_list(F.col("l_quantity").cast("long")))).alias("frames"), F.count("*").alias("n"))


@query("""with a as (select distinct l_orderkey as grp, l_linenumber as item from lineitem where l_quantity > 5), b as (select distinct l_orderkey as grp, l_linenumber as item from lineitem where l_discount < 0.09::double)
select *, 'first' as side from (select * from a except select * from b) union all select *, 'second' from (select * from b except select * from a)""")
def sidecar_sets(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("item"), "l_quantity", "l_discount")
    return gates.different_sets(li.where("l_quantity > 5"), li.where("l_discount < 0.09"), "grp", "item")


_CSV = "case o_orderkey % 4 when 0 then o_orderkey || ', ' || o_custkey when 1 then '' || o_orderkey when 2 then '-' || o_orderkey || ',5' else o_orderkey || ',x' end"


@query("select o_orderkey, case o_orderkey % 4 when 0 then to_json([o_orderkey, o_custkey]) when 1 then to_json([o_orderkey]) end as frames from orders")
def csv_frames(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.to_json(gates.frame_numbers(F.expr(_CSV))).alias("frames"))


@query(r"""select doc_id, md5(replace(text, '<', '<')) as script, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as attribute,
 md5(replace(url_encode(text), '%2F', '/')) as path from documents""")
def escapes(spark, d) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[F.md5(f(t).cast("binary")).alias(n) for f, n in ((gates.script_json, "script"), (gates.attribute_text, "attribute"), (gates.url_path, "path"))])


@query(r"""select page_id, case when page_id % 2 = 0 then lower(regexp_extract(url || '.' || s, '(\.[^./]+)$', 1)) in ('.mp4', '.mov') else lower(regexp_extract(url || '.' || s, '(\.[^./]+)$', 1)) in ('.jpg') end as allowed, regexp_matches(s, '^[A-Za-z0-9_]{1,64}$') and regexp_matches(s, '[A-Za-z0-9]') as named
 from (select *, case page_id % 5 when 0 then 'MP4' when 1 then 'jpg' when 2 then 'mov' when 3 then 'j-g' else '__' end as s from pages)""")
def suffixes_and_names(spark, d) -> DataFrame:
    key = F.col("page_id")
    s = F.when(key % 5 == 0, "MP4").when(key % 5 == 1, "jpg").when(key % 5 == 2, "mov").when(key % 5 == 3, "j-g").otherwise("__")
    allowed = gates.suffix_allowed(F.concat("url", F.lit("."), s), F.when(key % 2 == 0, "video").otherwise("photo"), {"video": (".mp4", ".mov"), "photo": (".jpg",)})
    return table(spark, d, "pages").select("page_id", allowed.alias("allowed"), gates.identifier(s).alias("named"))


@query("""with f as (select l_orderkey, l_linenumber, l_suppkey % 5 as number, l_partkey from lineitem), l as (select l_orderkey, number, max_by(l_partkey, l_linenumber * 1000000 + l_partkey % 1000000) as v from f where number in (1, 3, 4) group by 1, 2)
select l_orderkey, coalesce(max(v) filter (number = 1), -1) as width, coalesce(max(v) filter (number = 3), -1) as height, coalesce(max(v) filter (number = 4), -1) as rate from l group by l_orderkey""")
def named_fields(spark, d) -> DataFrame:
    c = F.col
    f = table(spark, d, "lineitem").select(c("l_orderkey").alias("source"), (c("l_linenumber") * 1000000 + c("l_partkey") % 1000000).alias("position"), (c("l_suppkey") % 5).cast("int").alias("number"), c("l_partkey").cast("long").alias("value"))
    out = gates.named_fields(f, {1: "width", 3: "height", 4: "rate"})
    return out.select(c("source").alias("l_orderkey"), *[F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(-1).cast("long")).alias(n) for n in ("width", "height", "rate")])


@query(f"""with {EVENTS}, a as (select *, (us - min(us) over (partition by user_id)) / 86400e6 as t from ev), b as (select *, max(t) over (partition by user_id) as last from a), i as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as k from b where t > greatest(5.0::double, 2.0::double) and t < last - 2)
select event_id from i where k % 5 = 0""")
def trimmed_decimation(spark, d) -> DataFrame:
    """Days as seconds."""
    e = events(spark, d)
    whole = W.partitionBy("user_id")
    e = e.withColumn("t", (F.col("us") - F.min("us").over(whole)) / 86400e6).withColumn("last", F.max("t").over(whole)).withColumn("clock", F.struct("t", "event_id"))
    return gates.trimmed(e, "user_id", "t", F.lit(0.0), F.col("last"), 5.0, 2.0, order="clock").select("event_id")


@query("""with s as (select o_orderkey as source, o_custkey::double as first, o_custkey + (o_orderkey % 50) / 10::double as last, greatest(0, ceil((o_orderkey % 50) / 10::double / 0.3 - 1e-9)::bigint - 1) as n from orders), t as (select source, unnest(list_transform(range(0, n + 1), lambda k: first + k * 0.3::double) || [last]) as t from s)
select distinct source, round(t, 6) as t from t""")
def anchor_times(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").cast("double").alias("first"), (F.col("o_custkey") + F.col("o_orderkey") % 50 / 10).alias("last"))
    return gates.anchor_times(o, 0.3).select("source", F.round("t", 6).alias("t")).distinct()


@query("""select o_orderkey, r::int as "row", round(o_custkey + (r / 32::double - 0.5::double) * 0.02::double, 9) as t from orders, (select unnest(range(33)) as r)""")
def row_trajectory_times(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("center"))
    return gates.row_times(o, "center", 0.02).select("o_orderkey", "row", F.round("t", 9).alias("t"))


@query(f"""with recursive {EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) as k, greatest(0.0::double, least(1.0::double, value / 100)) as q from ev), r as (
 select user_id, event_id, k, q as s, value from n where k = 1 union all select n.user_id, n.event_id, n.k, r.s + (1 - 0.7::double) * (n.q - r.s), n.value from r join n on n.user_id = r.user_id and n.k = r.k + 1)
select event_id, round(case when value > 1 and value < 98 then s else 0 end, 6) as quality from r""")
def smoothed_quality(spark, d) -> DataFrame:
    """A contrast that is smoothed over time, gated by the current frame's clipping."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100))
    smooth = S.ema(events(spark, d), SERIES, q, F.lit(True), 1 - 0.7, 1.0)
    out = smooth.join(events(spark, d).select("event_id", "value"), "event_id")
    return out.select("event_id", F.round(F.when((F.col("value") > 1) & (F.col("value") < 98), F.col("state")).otherwise(0.0), 6).alias("quality"))


C13 = (0.02, -0.01, 0.004, -0.001, 0.0005, 0.003, -0.002, 0.001, 0.0005, 0.002, -0.001, 0.0004, 0.0002)
LENS13 = L.Lens13.of_sensor(0.9, 900.0, 905.0, 1500.5, 1499.0, 3000, 2800, 1400, 0, C13)


@query("select count(*) as points, count(*) as found, 0 as missed from lineitem")
def undistort13(spark, d) -> DataFrame:
    """Lines as points: distorted and brought back."""
    p = table(spark, d, "lineitem").select(((F.col("l_quantity") - 25) / 40).alias("x"), ((F.col("l_discount") - 0.05) * 12).alias("y"))
    p = p.withColumn("moved", L.distort13(F.col("x"), F.col("y"), [F.lit(c) for c in C13])).withColumn("back", L.undistort13(F.col("moved.x"), F.col("moved.y"), list(C13)))
    miss = F.greatest(F.abs(F.col("back.x") - F.col("x")), F.abs(F.col("back.y") - F.col("y"))) > 1e-9
    return p.agg(F.count("*").alias("points"), F.count_if("back.valid").alias("found"), F.count_if(miss).cast("int").alias("missed"))


@query("select count(*) as points, count(*) as valid, 0 as missed from orders")
def project13_round_trip(spark, d) -> DataFrame:
    """Orders as pixels: to rays and back."""
    p = table(spark, d, "orders").select((F.col("o_orderkey") % 1000 + 200.0).alias("u"), (F.col("o_custkey") % 1000 + 200.0).alias("v"))
    p = L.unproject13(p, LENS13, "u", "v", "ray").withColumn("p", L.project13(LENS13, F.col("ray.x"), F.col("ray.y"), F.col("ray.z")))
    miss = F.greatest(F.abs(F.col("p.u") - F.col("u")), F.abs(F.col("p.v") - F.col("v"))) > 1e-6
    return p.agg(F.count("*").alias("points"), F.count_if(F.col("ray.valid") & F.col("p.valid")).alias("valid"), F.count_if(miss).cast("int").alias("missed"))


@query("""with a as (select p_partkey, radians((p_partkey * 7) % 360) as a, radians((p_size * 11) % 360 + 90) as b, radians((p_partkey * 13) % 360) as c from part)
select p_partkey, round(cos(b) * cos(a), 6) + 0.0 as x, round(sin(a), 6) + 0.0 as y, round(-sin(b) * cos(a), 6) + 0.0 as z from a""")
def recorded_pose(spark, d) -> DataFrame:
    """The turned x axis of each part's pose."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", L.recorded_pose((key * 7).cast("double"), (F.col("p_size") * 11).cast("double"), (key * 13).cast("double"), 1).alias("q"))
    p = p.withColumn("v", Q.rotate(F.col("q"), F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return p.select("p_partkey", *[(F.round(f"v.{c}", 6) + 0.0).alias(c) for c in "xyz"])


SCAN = L.Lens(1.2, 90.0, 90.0, 63.5, 63.5, 128, (0.02, -0.005, 0.001, -0.002, 0.0005))


@query()
def rolling_shutter_projection(spark, d) -> DataFrame:
    """Line items as rays (their price is the longitude, their quantity the latitude), seen by a lens that turns at a radian a second."""
    c = F.col
    lon, lat = F.radians(c("l_extendedprice") % 360), F.radians((c("l_quantity") - 25.5) * 3)
    ray = F.struct((F.sin(lon) * F.cos(lat)).alias("x"), (-F.sin(lat)).alias("y"), (F.cos(lon) * F.cos(lat)).alias("z"))
    rays = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ray.alias("r"))
    out = L.project_scan(rays, SCAN, "r", (0.0, 0.6, 0.8), 0.02, "p")
    return out.select("l_orderkey", "l_linenumber", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"), "p.valid")


@query()
def rigid_background(spark, d) -> DataFrame:
    """Directions in blocks of 500 ids and the same ones turned, a quarter of them wrong."""
    e = table(spark, d, "embeddings")
    x, y, z = (F.element_at("embedding", k).cast("double") for k in (1, 2, 3))
    n = F.sqrt(x * x + y * y + z * z)
    e = e.where(n > 0).select(F.floor(F.col("vec_id") / 500).alias("pair"), "vec_id", (x / n).alias("ax"), (y / n).alias("ay"), (z / n).alias("az"))
    c, s, wrong = math.cos(0.2), math.sin(0.2), F.col("vec_id") % 4 == 0
    b = [F.when(wrong, F.col("az")).otherwise(F.col("ax") * c - F.col("ay") * s), F.when(wrong, F.col("ax")).otherwise(F.col("ax") * s + F.col("ay") * c), F.when(wrong, F.col("ay")).otherwise(F.col("az"))]
    out = calibration.rigid_background(e.select("pair", "ax", "ay", "az", *[v.alias(f"b{k}") for v, k in zip(b, "xyz", strict=True)]), "pair")
    return out.select("pair", "tracks", "inliers", F.round("median_degrees", 6).alias("median_degrees"), "status")


_GRID = "g as (select (p_partkey // 20)::int as row, (p_partkey % 20)::int as col, (p_size - 25) / 40::double as fx, ((p_partkey * 7) % 11 - 5) / 8::double as fy, (p_partkey % 15)::double as texture, p_partkey % 37 <> 0 as valid, p_size * 5::double as value from part)"


def _pixels(spark, d) -> DataFrame:
    """Parts as the pixels of a picture of 20 columns and as many rows as there are."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.lit(0).alias("frame"), F.floor(key / 20).cast("int").alias("row"), (key % 20).cast("int").alias("col"), ((F.col("p_size") - 25) / 40).alias("fx"), (((key * 7) % 11 - 5) / 8).alias("fy"),
        (key % 15).cast("double").alias("texture"), (key % 37 != 0).alias("valid"), (F.col("p_size") * 5.0).alias("value"),
    )


@query(f"""with {_GRID}, e as (select *, col + fx as x, row + fy as y from g where valid), c as (select row, col, fx, fy, (floor(x)::int + dx + 20) % 20 as c, floor(y)::int + dy as r, case when dx = 1 then x - floor(x) else 1 - (x - floor(x)) end * case when dy = 1 then y - floor(y) else 1 - (y - floor(y)) end as w
 from e, (values (0, 0), (1, 0), (0, 1), (1, 1)) as k(dx, dy)), b as (select c.row, c.col, sum(w * -g.fx * 0.9::double) as bx, sum(w * -g.fy * 0.9::double) as b_y, sum(w) as covered from c join g on g.row = c.r and g.col = c.c and g.valid group by 1, 2), t as (
 select g.row, g.col, covered, sqrt((fx + bx) ** 2 + (fy + b_y) ** 2) as error, sqrt((fx * 0.03::double) ** 2 + (fy * 0.03::double) ** 2) as moved, texture, valid from g left join b on b.row = g.row and b.col = g.col), s as (
 select *, greatest(0.0::double, least(1.0::double, 1.5::double - error)) as a, greatest(0.0::double, least(1.0::double, (texture - 1) / 12)) as q from t)
select row, col, round(case when coalesce(valid and covered > 0.99::double and moved < radians(2), false) then a * a * (3 - 2 * a) * q * q * (3 - 2 * q) else 0 end, 6) as trust from s""")
def flow_trust(spark, d) -> DataFrame:
    p = _pixels(spark, d)
    back = p.withColumns({"fx": -F.col("fx") * 0.9, "fy": -F.col("fy") * 0.9})
    return frames.flow_trust(p, back, 20, 0.03, 0.03).select("row", "col", F.round("trust", 6).alias("trust"))


@query(f"""with {_GRID}, l as (select value, coalesce(lag(value) over a, lead(value) over a, value) + coalesce(lead(value) over a, lag(value) over a, value) + coalesce(lag(value) over b, lead(value) over b, value) + coalesce(lead(value) over b, lag(value) over b, value) - 4 * value as l
 from g window a as (partition by row order by col), b as (partition by col order by row)) select 0 as frame, round(avg(value) / 255, 9) as luminance, round(var_pop(l), 6) as detail from l""")
def picture_statistics(spark, d) -> DataFrame:
    out = frames.picture_statistics(_pixels(spark, d), "frame")
    return out.select("frame", F.round("luminance", 9).alias("luminance"), F.round("detail", 6).alias("detail"))


@query("""with l as (select l_orderkey * 10 + l_linenumber as line, l_quantity / 50 as alpha, l_discount * 10 as trust, ln((l_tax + 0.01::double) / (l_discount + 0.01::double)) as r from lineitem)
select line, round((1 - alpha) * trust, 6) as first, round(alpha * trust, 6) as second, round(exp(least(r, 0)), 6) as gain0, round(exp(least(-r, 0)), 6) as gain1 from l""")
def seam_gains(spark, d) -> DataFrame:
    c = F.col
    first, second = frames.displacement(c("l_quantity") / 50, c("l_discount") * 10)
    gain0, gain1 = frames.gains(F.ln((c("l_tax") + 0.01) / (c("l_discount") + 0.01)))
    return table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("line"), *[F.round(x, 6).alias(n) for x, n in ((first, "first"), (second, "second"), (gain0, "gain0"), (gain1, "gain1"))])


def _rays(e: DataFrame) -> DataFrame:
    x, y, z = (F.element_at("embedding", k).cast("double") for k in (1, 2, 3))
    n = F.sqrt(x * x + y * y + z * z)
    return e.select("label", "vec_id", "embedding", *[F.when(n > 0, v / n).alias(c) for v, c in zip((x, y, z), "xyz", strict=True)])


@query()
def matched_rotations(spark, d) -> DataFrame:
    """Vectors as descriptors of two frames of which the second is turned: what matches gives the turn."""
    e = _rays(table(spark, d, "embeddings"))
    c, s = math.cos(0.3), math.sin(0.3)
    turned = e.select("label", "vec_id", "embedding", (F.col("x") * c - F.col("y") * s).alias("x"), (F.col("x") * s + F.col("y") * c).alias("y"), "z")
    out = frames.matched_rotations(e, turned, "label", "vec_id", "embedding")
    return out.select("label", "pairs", "inliers", "status", F.round(F.get("rotation", F.lit(0)), 6).alias("cosine"))


@query()
def face_observations(spark, d) -> DataFrame:
    """The background fits of blocks of 500 ids with the tracks of their six faces."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 500).alias("pair"), (F.col("vec_id") % 6).cast("int").alias("face"))
    r = _rays(table(spark, d, "embeddings")).where("x is not null").withColumn("pair", F.floor(F.col("vec_id") / 500))
    fits = calibration.rigid_background(r.select("pair", *[F.col(c).alias(f"{k}{c}") for k in "ab" for c in "xyz"]), "pair")
    out = frames.face_observations(fits, e, "pair")
    return out.select("pair", F.to_json("tracks_per_face").alias("tracks_per_face"), "status", "inliers", F.round("p95_degrees", 6).alias("p95_degrees"), F.round("unmatched", 6).alias("unmatched"))
