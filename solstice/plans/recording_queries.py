"""Recordings of all events: one per user, written by tasks into files of many in the shared folder and read back by ranges."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions.numeric import angle_between, chord_angle
from ..operators import gps, inspection
from ..operators import series as S
from ..operators.groups import starts, whole
from ..sources import recording_source, synthetic, trailer
from ..sources.scratch import scratch
from ..streaming import tracks
from ..streaming.replay import replay
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


def _recording(rows: pd.DataFrame) -> bytes:
    """A user's events, in order, as exposures, positions, poses and raw motion, and a message about them."""
    n, us, value, key = len(rows), rows.us.to_numpy(), rows.value.to_numpy(float), rows.event_id.to_numpy()
    times = np.zeros(n, [("t", "<u8"), ("seconds", "<f8")])
    times["t"], times["seconds"] = us, (value + 1) / 1000
    places = np.zeros(n, [("s", "<u8"), ("ms", "<u2"), ("fix", "S1"), ("lat", "<f8"), ("ns", "S1"), ("lon", "<f8"), ("ew", "S1"), ("speed", "<f8"), ("course", "<f8"), ("alt", "<f8")])
    places["s"], places["ms"], places["fix"] = us // 1_000_000, us // 1000 % 1000, np.where(rows.event_type == "error", b"V", b"A")
    places["lat"], places["ns"], places["lon"], places["ew"] = value / 2, np.where(key % 2 == 0, b"N", b"S"), value / 3, np.where(key % 3 == 0, b"W", b"E")
    places["speed"], places["course"], places["alt"] = value - 5, key % 400, value - 100
    poses = np.zeros(n, [("t", "<u8"), *[(c, "<f4") for c in ("x", "y", "z", "w", "a", "b", "c")]])
    poses["t"], poses["x"], poses["w"] = us, np.sin(value / 100), np.cos(value / 100)
    motion = np.zeros(n, [("t", "<u8"), *[(c, "<u2") for c in ("ax", "ay", "az", "gx", "gy", "gz")]])
    motion["t"], motion["ax"], motion["gz"] = us, 1 + key % 65535, np.where(key % 50 == 0, 65535, 32768)
    for c in ("ay", "az", "gx", "gy"):
        motion[c] = 32768
    about = synthetic.number_field(20, n) + synthetic.number_field(24, int(us[0]))
    return synthetic.recording({trailer.METADATA: about, trailer.EXPOSURE: times.tobytes(), trailer.GPS: places.tobytes(), trailer.ATTITUDE: poses.tobytes(), trailer.RAW_MOTION: motion.tobytes()})


#: Bytes from which a task begins another file of recordings.
SHARD_BYTES = 128 << 20
#: The manifest of a table's recordings, by application and folder of the table.
_made: dict[tuple[str, str], str] = {}


def _manifest(spark, d) -> str:
    """Recordings of all events, written once an application: a recording per user, one behind the other in files under the name of the attempt that wrote them, and a table of those that count."""
    known = (spark.sparkContext.applicationId, d)
    if known in _made:
        return _made[known]
    folder = f"{scratch(spark)}-recordings"

    def write(batches):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name, file, at = "", None, 0
        try:
            for rows in whole(batches, ["user_id"]):
                made, bounds = [], starts(rows, ["user_id"]).tolist()
                for a, z in zip(bounds, [*bounds[1:], len(rows)], strict=True):
                    if file is None or at >= SHARD_BYTES:
                        if file is not None:
                            file.close()
                        name, at = f"{uuid.uuid4().hex}.bin", 0
                        file = system.open_output_stream(f"{path}/{name}")
                    content = _recording(rows.iloc[a:z])
                    file.write(content)
                    made.append((f"{folder}/{int(rows.user_id.iloc[a])}-{name}", len(content), f"{folder}/{name}", at))
                    at += len(content)
                yield pd.DataFrame(made, columns=["source", "length", "path", "start"])
        finally:
            if file is not None:
                file.close()

    rows = events(spark, d).select("user_id", "us", "event_id", "event_type", "value").repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    made = rows.mapInPandas(write, "source string, length long, path string, start long")
    made.write.parquet(f"{folder}-manifest")
    _made[known] = f"{folder}-manifest"
    return _made[known]


def release(spark) -> None:
    """Deletes the recordings that this application has written."""
    for known in [x for x in _made if x[0] == spark.sparkContext.applicationId]:
        system, path = fs.FileSystem.from_uri(_made.pop(known))
        for place in (path, path.removesuffix("-manifest")):
            system.delete_dir(place)


def _scan(spark, d, stream: str, columns: str | None = None, **options) -> DataFrame:
    return recording_source.scan(spark, stream, columns, manifest=_manifest(spark, d), **options)


def _user(df: DataFrame) -> DataFrame:
    return df.withColumn("user_id", F.regexp_extract("source", r"(\d+)-[0-9a-f]+\.bin$", 1).cast("long")).drop("source")


@query("""with n as (select user_id, count(*) as n from events group by user_id) select user_id, kind::int as kind, (n * width)::bigint as size, 3 as version
 from n, (values (3, 20), (4, 16), (7, 53), (37, 36)) as k(kind, width)""")
def trailer_inventory(spark, d) -> DataFrame:
    return _user(_scan(spark, d, "records", "source string, kind int, size long, version int").where(F.col("kind") != trailer.METADATA)).select("user_id", "kind", "size", "version")


@query(f"""with {EVENTS} select user_id, 20 as number, count(*) as value from ev group by user_id union all select user_id, 24, min(us) from ev group by user_id""")
def protobuf_fields(spark, d) -> DataFrame:
    return _user(_scan(spark, d, "metadata")).select("user_id", "number", "value")


@query(f"""with {EVENTS}, s as (select user_id, us, (value + 1) / 1000 as x, us - lag(us) over (partition by user_id order by us, event_id) as step from ev), m as (
 select user_id, count(*) as samples, min(us) as first_us, max(us) as last_us, quantile_cont(step, 0.5) as median_step, count(*) filter (step <= 0) as not_increasing, min(x) as least, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.95) as p95, max(x) as largest from s group by user_id)
select user_id, samples, first_us, last_us, median_step, not_increasing, round(least, 9) as least, round(median, 9) as median, round(p95, 9) as p95, round(largest, 9) as largest, (select count(*) from s where s.user_id = m.user_id and step > 2 * median_step) as gaps, round((largest - least) / 2, 9) as half_range from m""")
def exposure_summary(spark, d) -> DataFrame:
    out = _user(inspection.exposure_summary(_scan(spark, d, "exposure")))
    return out.withColumns({c: F.round(c, 9) for c in ("least", "median", "p95", "largest", "half_range")})


@query(f"""with {EVENTS}, s as (select *, us - lag(us) over (partition by user_id order by us, event_id) as step from ev)
select user_id, count(*) as samples, round((count(*) - 1) * 1e6 / nullif(max(us) - min(us), 0), 9) as mean_hz, round(1e6 / quantile_cont(step, 0.5), 9) as median_hz, max(step) as largest_step, count(*) filter (event_id % 50 = 0 or event_id % 65535 = 65534) as saturated from s group by user_id""")
def motion_summary(spark, d) -> DataFrame:
    out = _user(inspection.motion_summary(_scan(spark, d, "raw_motion")))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_hz", "median_hz")})


@query(f"""with {EVENTS}, s as (select user_id, us > lag(us) over (partition by user_id order by us, event_id) as later from ev) select user_id, 1.0::double as least, 1.0::double as largest, bool_and(coalesce(later, true)) as increasing from s group by user_id""")
def attitude_quality(spark, d) -> DataFrame:
    out = _user(inspection.orientation_quality(_scan(spark, d, "attitude")))
    return out.withColumns({c: F.round(c, 5) for c in ("least", "largest")})


@query(f"with {EVENTS} select event_id, round((1 + event_id % 65535 - 32768) * 16 / 32768.0::double, 9) as g from ev")
def scaled_counts(spark, d) -> DataFrame:
    """Offset-binary counts in units of a range of 16."""
    e = events(spark, d)
    return e.select("event_id", F.round(trailer.scale(1 + F.col("event_id") % 65535, 16.0), 9).alias("g"))


_POSITIONS = f"""{EVENTS}, m as (select user_id, us // 1000 as ms, event_type = 'error' as void, value / 2 > 90 or value / 3 > 180 as bad, value, event_id, row_number() over (partition by user_id order by us, event_id) - 1 as sample from ev), l as (
 select *, last_value(case when not void then ms end ignore nulls) over (partition by user_id order by sample rows between unbounded preceding and 1 preceding) as seen from m), b as (
 select *, sum(case when void or bad or coalesce(ms - seen > {DAY // 1000}, false) then 1 else 0 end) over (partition by user_id order by sample rows unbounded preceding) as run from l), p as (
 select *, dense_rank() over (partition by user_id order by run) as segment from b where not void and not bad)"""


@query(f"""with {_POSITIONS} select user_id, segment::int as segment, sample::bigint as sample, ms as utc_ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as utc, round(value / 2 * case when event_id % 2 = 0 then 1 else -1 end, 9) as lat, round(value / 3 * case when event_id % 3 = 0 then -1 else 1 end, 9) as lon,
 round(value - 100, 6) as elevation_m, case when value >= 5 then round(value - 5, 6) end as speed_mps, case when event_id % 400 < 360 then (event_id % 400)::double end as course_degrees from p""")
def gps_decode(spark, d) -> DataFrame:
    p = _user(gps.positions(_scan(spark, d, "gps"), DAY / 1e6))
    return p.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9), "elevation_m": F.round("elevation_m", 6), "speed_mps": F.round("speed_mps", 6)})


@query(f"""with {_POSITIONS}, s as (select user_id, count(*) as samples, count(*) filter (void) as void from m group by user_id), q as (
 select user_id, count(*) as points, count(distinct segment) as segments, sum(case when value < 5 then 1 else 0 end + case when event_id % 400 >= 360 then 1 else 0 end)::bigint as omitted, min(ms) as first_ms, max(ms) as last_ms from p group by user_id)
select s.*, q.points, q.segments, q.omitted, q.first_ms, q.last_ms, samples - void - coalesce(points, 0) as invalid from s left join q using (user_id)""")
def gps_summary(spark, d) -> DataFrame:
    samples = _scan(spark, d, "gps")
    return _user(gps.position_summary(samples, gps.positions(samples, DAY / 1e6)))


@query(f"""with {EVENTS}, m as (select user_id, us // 1000 as ms, event_id as sample, value from ev where event_type <> 'error'), l as (select *, lag(ms) over (partition by user_id order by sample) as before from m)
select user_id, sample, 'increasing time' as rule from l where ms <= before union all select user_id, sample, 'status or hemisphere' from l where value > 90""")
def position_contract(spark, d) -> DataFrame:
    """Events in the order of their ids as positions, some with a letter that is no hemisphere."""
    e = events(spark, d)
    samples = e.select(
        F.col("user_id").alias("source"), F.col("event_id").alias("sample"), F.floor(F.col("us") / 1_000_000).alias("utc_s"), (F.floor(F.col("us") / 1000) % 1000).cast("int").alias("ms"), F.when(F.col("event_type") == "error", "V").otherwise("A").alias("fix"),
        F.when(F.col("value") > 90, "Q").otherwise("N").alias("ns"), F.lit("E").alias("ew"),
    )
    return gps.position_violations(samples).withColumnRenamed("source", "user_id")


@query(f"""with recursive {EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) as k from ev), r as (select user_id, event_id, k, value as s from n where k = 1 union all
 select n.user_id, n.event_id, n.k, r.s + greatest(-2.5::double, least(2.5::double, n.value - r.s)) from r join n on n.user_id = r.user_id and n.k = r.k + 1) select event_id, round(s, 6) as state from r""")
def paced_state(spark, d) -> DataFrame:
    return S.paced(events(spark, d), SERIES, F.col("value"), 2.5).select("event_id", F.round("state", 6).alias("state"))


@query(f"""with recursive {EVENTS}, n as (select *, row_number() over (partition by user_id order by us, event_id) as k from ev), r as (select user_id, event_id, k, case when event_type <> 'error' then value end as s from n where k = 1 union all
 select n.user_id, n.event_id, n.k, case when n.event_type <> 'error' then case when r.s is null then n.value else r.s + greatest(-4.0::double, least(4.0::double, 0.3::double * (n.value - r.s))) end else r.s * 0.61::double end from r join n on n.user_id = r.user_id and n.k = r.k + 1) select event_id, round(s, 6) as state from r""")
def decaying_state_stream(spark, d) -> DataFrame:
    """The decaying state from a stateful stream over the events' file."""

    def transform(stream: DataFrame) -> DataFrame:
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        rows = stream.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), us.alias("us"), "value", (F.col("event_type") != "error").alias("supported"))
        return tracks.decaying_state(rows, 0.3, 0.61, 4.0)

    return replay(table(spark, d, "events"), d, "events.parquet", transform).select(F.col("id").alias("event_id"), F.round("state", 6).alias("state"))


@query("""select p_partkey, p_size >= 10 and p_size < 40 and p_retailprice >= 950 and p_retailprice < 1050 as inside, 3000.0::double as area from part""")
def polygon_test(spark, d) -> DataFrame:
    """Parts as points against a rectangle; many lie on its border, of which the least x and y belong to it."""
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 950.0), (40.0, 950.0), (40.0, 1050.0), (10.0, 1050.0))])
    return table(spark, d, "part").select("p_partkey", inspection.in_polygon(corners, F.col("p_size") + 0.0, F.col("p_retailprice")).alias("inside"), inspection.polygon_area(corners).alias("area"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 0.0 when o_orderkey % 3 = 1 and o_custkey % 60 <= 1000 / (20 + o_orderkey % 40)::double then o_custkey % 60 / 1000::double end as seconds, abs((20 + o_orderkey % 40)::double - 29.97::double) <= 0.0011::double * 29.97::double as nominal from orders""")
def readout_policy(spark, d) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    fps = (20 + key % 40).cast("double")
    policy = F.when(key % 3 == 0, "off").when(key % 3 == 1, "auto").otherwise("other")
    return o.select("o_orderkey", inspection.readout(policy, fps, (F.col("o_custkey") % 60).cast("double")).alias("seconds"), inspection.nominal_rate(fps, F.lit(29.97)).alias("nominal"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then null else round(p_size + p_retailprice, 6) end as total from part""")
def lens_numbers(spark, d) -> DataFrame:
    """Two numbers in a text; in some of them a word or one too many."""
    key = F.col("p_partkey")
    text = F.concat_ws("_", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.when(key % 4 == 0, "x"), F.when(key % 4 == 1, "5"))
    n = inspection.lens_numbers(text, 2)
    return table(spark, d, "part").select("p_partkey", F.round(F.get(n, F.lit(0)) + F.get(n, F.lit(1)), 6).alias("total"))


_CODECS = {0: "h264", 1: "hevc", 2: "vp9"}


@query("""with s as (select o_orderkey as source, o_custkey % 3 as codec, o_orderkey % 7 = 0 as single, o_orderkey % 5 = 0 as wide, o_orderkey % 11 = 0 as slow from orders)
select source, 'two streams' as rule from s where single union all select source, 'alike' from s where wide and not single union all select source, 'square' from s where wide union all select source, 'codec' from s where codec = 2 union all select source, 'rate' from s where slow""")
def video_contract(spark, d) -> DataFrame:
    """Orders as probe documents of two video streams with various faults."""
    key, codec = F.col("o_orderkey"), F.create_map(*[F.lit(x) for pair in _CODECS.items() for x in pair])[F.col("o_custkey").cast("int") % 3]
    rate = F.when(key % 11 == 0, "121/1").otherwise("30000/1001")

    def stream(height):
        return F.struct(F.lit("video").alias("codec_type"), codec.alias("codec_name"), F.lit(2880).alias("width"), height.alias("height"), rate.alias("r_frame_rate"), rate.alias("avg_frame_rate"), F.lit("90").alias("nb_frames"))

    first = stream(F.when(key % 5 == 0, 2000).otherwise(2880))
    streams = F.when(key % 7 == 0, F.array(first)).otherwise(F.array(first, stream(F.lit(2880))))
    docs = table(spark, d, "orders").select(key.alias("source"), F.to_json(F.struct(streams.alias("streams"))).alias("json"))
    return inspection.video_violations(inspection.probe_streams(docs))


@query("""select o_orderkey as source, case when o_orderkey % 6 = 0 then 'absent' when o_orderkey % 6 = 1 then 'codec' when o_custkey % 4 = 0 then 'rate' when o_orderkey % 6 = 2 then 'channels' when o_orderkey % 6 = 3 then 'start' when o_orderkey % 6 = 4 and o_custkey % 2 = 1 then 'length' else 'ok' end as status from orders""")
def audio_profile(spark, d) -> DataFrame:
    """Orders as audio streams."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    codec, rate = F.when(key % 6 == 1, "mp3").otherwise("aac"), F.when(other % 4 == 0, "44100").otherwise("48000")
    one = F.struct(codec.alias("codec_name"), rate.alias("sample_rate"), F.when(key % 6 == 2, 6).otherwise(2).alias("channels"), F.when(key % 6 == 3, "-0.5").otherwise("0.0").alias("start_time"), F.when((key % 6 == 4) & (other % 2 == 1), 0).otherwise(1024).alias("duration_ts"))
    rows = table(spark, d, "orders").select(key.alias("source"), F.when(key % 6 != 0, one).alias("audio"))
    return rows.select("source", inspection.audio_profile(F.col("audio")).alias("status"))


@query("""select l_orderkey * 10 + l_linenumber as line, round(degrees(acos(greatest(-1.0::double, least(1.0::double, l_quantity / 25 - 1)))), 6) as apart, round(degrees(2 * asin(least(1.0::double, l_quantity / 40))), 6) as arc, round(l_discount, 6) as heading from lineitem""")
def angles(spark, d) -> DataFrame:
    """Angles by dot product and by chord, and the heading of a turn about z."""
    q = F.col("l_quantity")
    li = table(spark, d, "lineitem").withColumn("turn", Q.about_axis("z", F.col("l_discount")))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.round(angle_between(q / 25 - 1), 6).alias("apart"), F.round(chord_angle(q / 20), 6).alias("arc"), F.round(Q.heading(F.col("turn")), 6).alias("heading"))


@query(f"""with {_POSITIONS}, n as (select user_id, count(*) as n, min(us) as first_us, count(*) filter (event_id % 50 = 0 or event_id % 65535 = 65534) as saturated from ev group by user_id), s as (select user_id, us - lag(us) over (partition by user_id order by us, event_id) as step from ev), o as (
 select user_id, count(*) filter (step <= 0) as stuck from s group by user_id), q as (select user_id, count(*) as points from p group by user_id)
select n.user_id, 5::bigint as records, n as frames, first_us, n as exposures, n as motions, saturated, coalesce(points, 0) as points,
 case when stuck > 0 then 'exposure clock,' else '' end || case when saturated > 0 then 'motion saturated,' else '' end || case when stuck > 0 then 'attitude clock,' else '' end || case when coalesce(points, 0) = 0 then 'no positions,' else '' end as problems from n join o using (user_id) left join q using (user_id)""")
def inspect_report(spark, d) -> DataFrame:
    samples = _scan(spark, d, "gps")
    out = inspection.report(
        _scan(spark, d, "records"), _scan(spark, d, "metadata"), inspection.exposure_summary(_scan(spark, d, "exposure")), inspection.motion_summary(_scan(spark, d, "raw_motion")),
        inspection.orientation_quality(_scan(spark, d, "attitude")), gps.position_summary(samples, gps.positions(samples, DAY / 1e6)), {20: "frames", 24: "first_us"},
    )
    out = _user(out.where(F.length("fingerprint") == 64))
    problems = F.concat(F.array_join("problems", ","), F.when(F.size("problems") > 0, ",").otherwise(""))
    return out.select(
        "user_id", F.size("records").cast("long").alias("records"), F.col("fields")["frames"].alias("frames"), F.col("fields")["first_us"].alias("first_us"), F.col("exposure.samples").alias("exposures"), F.col("motion.samples").alias("motions"),
        "motion.saturated", F.coalesce("positions.points", F.lit(0).cast("long")).alias("points"), problems.alias("problems"),
    )


@query(f"""with {EVENTS}, s as (select user_id, us - lag(us) over (partition by user_id order by us, event_id) as step from ev) select user_id, case when count(*) filter (step <= 0) > 0 then 'exposure clock does not increase' else 'no first frame or no motion ranges' end as reason from s group by user_id""")
def recording_faults(spark, d) -> DataFrame:
    """Recordings of which a stream breaks a rule, read through chunk by chunk, with the first reason: some have equal times, and none tells the ranges of its motion sensor."""
    return _user(_scan(spark, d, "faults"))


@query(f"""with {EVENTS}, b as (select min(us) as a, max(us) as z from ev) select user_id, us, round((value + 1) / 1000, 9) as seconds from ev, b where us >= a + (z - a) // 3 and us < a + (z - a) // 2""")
def exposures_in_range(spark, d) -> DataFrame:
    """The exposures of the middle sixth of all time: bounds of the clock choose what is read of each recording."""
    ends = events(spark, d).agg(F.min("us").alias("a"), F.max("us").alias("z")).first()
    low, high = ends.a + (ends.z - ends.a) // 3, ends.a + (ends.z - ends.a) // 2
    rows = _scan(spark, d, "exposure", split_bytes=4096).where((F.col("us") >= low) & (F.col("us") < high))
    return _user(rows).select("user_id", "us", F.round("seconds", 9).alias("seconds"))
