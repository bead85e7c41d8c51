"""Contracts, joins, sets, matching and rational arithmetic on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import matching, neighbours
from .tables import EVENTS, events, table


def contract_single_valued(spark, d) -> DataFrame:
    return C.single_valued(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


SINGLE = """select l_orderkey, count(*) as n, count(distinct l_returnflag) = 1 as single_l_returnflag, count(distinct l_linestatus) = 1 as single_l_linestatus from lineitem group by l_orderkey"""


def adapter_lookup_unknowns(spark, d) -> DataFrame:
    """Nations by region name; every second region is not in the dimension."""
    regions = table(spark, d, "region").where("r_regionkey % 2 = 0")
    return C.lookup(table(spark, d, "nation"), regions, "n_regionkey", "r_regionkey", "r_name").select("n_nationkey", "n_name", "r_name")


ADAPTER = """select n_nationkey, n_name, coalesce(r_name, 'unknown') as r_name from nation left join (select * from region where r_regionkey % 2 = 0) r on n_regionkey = r_regionkey"""


def mode_resolution(spark, d) -> DataFrame:
    """Status and priority of an order as two declarations of its mode."""
    status = F.when(F.col("o_orderstatus") == "F", "fast").when(F.col("o_orderstatus") == "O", "slow")
    priority = F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), "fast").when(F.col("o_orderpriority").startswith("5"), "unknown").when(F.col("o_orderpriority").startswith("3"), "slow")
    modes = table(spark, d, "orders").withColumn("mode", C.resolve_mode(status, priority))
    return modes.groupBy("o_orderstatus", "o_orderpriority", "mode").agg(F.count("*").alias("n"))


MODE = """with m as (select o_orderstatus, o_orderpriority, case o_orderstatus when 'F' then 'fast' when 'O' then 'slow' end as a,
 case left(o_orderpriority, 1) when '1' then 'fast' when '2' then 'fast' when '5' then 'unknown' when '3' then 'slow' end as b from orders)
select o_orderstatus, o_orderpriority, case when a = 'unknown' or b = 'unknown' then 'unknown' when a <> b then 'conflicting' else coalesce(a, b, 'unspecified') end as mode, count(*) as n from m group by 1, 2, 3"""


def option_violations(spark, d) -> DataFrame:
    rules = {"discount": F.col("l_discount") <= 0.08, "quantity": F.col("l_quantity").between(2, 48), "tax with discount": (F.col("l_tax") < 0.07) | (F.col("l_discount") > 0.01)}
    lines = table(spark, d, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return C.violations(lines, "line", rules)


OPTIONS = """select l_orderkey * 10 + l_linenumber as line, 'discount' as rule from lineitem where not l_discount <= 0.08::double
union all select l_orderkey * 10 + l_linenumber, 'quantity' from lineitem where not l_quantity between 2 and 48
union all select l_orderkey * 10 + l_linenumber, 'tax with discount' from lineitem where not (l_tax < 0.07::double or l_discount > 0.01::double)"""


def _receipts(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))


def resume_semi(spark, d) -> DataFrame:
    return C.done(table(spark, d, "orders"), _receipts(spark, d), "o_orderkey").select("o_orderkey", "o_totalprice")


def resume_anti(spark, d) -> DataFrame:
    return C.pending(table(spark, d, "orders"), _receipts(spark, d), "o_orderkey").select("o_orderkey", "o_totalprice")


_RESUME = "select o_orderkey, o_totalprice from orders where {} exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 45)"


def path_collisions(spark, d) -> DataFrame:
    outputs = table(spark, d, "pages").select(F.concat(F.lit("/out/"), F.regexp_extract("url", r"/([a-z]+)/\d+", 1)).alias("path"))
    inputs = table(spark, d, "documents").select(F.concat(F.lit("/out/"), F.col("lang")).alias("path"))
    return C.collisions(outputs, inputs, "path")


COLLISIONS = r"""with o as (select '/out/' || regexp_extract(url, '/([a-z]+)/\d+', 1) as path from pages), i as (select '/out/' || lang as path from documents)
select path, 'is an input' as reason from (select path from o intersect select path from i)
union all select path, 'written twice' from o group by path having count(*) > 1"""


def set_difference_fields(spark, d) -> DataFrame:
    """Values of the property k that purchases have and errors lack."""
    e = events(spark, d).select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where("event_type = 'purchase'").select("k").exceptAll(e.where("event_type = 'error'").select("k")).distinct()


FIELDS = """with e as (select event_type, json_extract_string(props, '$.k')::bigint as k from events)
select distinct k from (select k from e where event_type = 'purchase' except all select k from e where event_type = 'error')"""


def edge_identity_hash(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.edge_hash(F.col("text"), 256).alias("edge_sha256"))


EDGE = """select doc_id, sha256(substring(text, 1, 256) || substring(text, greatest(length(text) - 255, 1), 256)) as edge_sha256 from documents"""


def nearest2_ratio_test(spark, d) -> DataFrame:
    """Even vectors of a label against its odd ones."""
    e = table(spark, d, "embeddings")
    out = neighbours.nearest_two(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "vec_id", "vec_id", "embedding", 0.95)
    return out.select("label", "query_id", "base_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"), "kept")


NEAREST = """with p as (select a.label, a.vec_id as query_id, b.vec_id as base_id, list_distance(a.embedding::double[], b.embedding::double[]) as d
 from embeddings a join embeddings b on a.label = b.label and a.vec_id % 2 = 0 and b.vec_id % 2 = 1), r as (
 select *, row_number() over (partition by label, query_id order by d, base_id) as k from p)
select o.label, o.query_id, o.base_id, round(o.d, 6) as d1, round(t.d, 6) as d2, o.d < 0.95::double * t.d as kept from r o join r t on o.label = t.label and o.query_id = t.query_id and o.k = 1 and t.k = 2"""


def _medoids(spark, d, ids: int) -> DataFrame:
    """All vectors: those of a label among so many neighbouring ids are a group of candidate fits."""
    group = F.struct("label", F.floor(F.col("vec_id") / ids).alias("block"))
    e = table(spark, d, "embeddings").select(group.alias("fits"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    square = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    out = matching.medoid(e, "fits", "vec_id", lambda a, b: F.round(F.sqrt(square), 9), 1.4)
    return out.select("fits.label", "fits.block", "vec_id", F.round("median_distance", 6).alias("median_distance"), "consistent", "n", "accepted")


def medoid_consensus(spark, d) -> DataFrame:
    return _medoids(spark, d, 240)


def medoid_blocks(spark, d) -> DataFrame:
    return _medoids(spark, d, 120)


def _medoid_sql(ids: int) -> str:
    return f"""with c as (select label, vec_id // {ids} as block, vec_id, embedding::double[] as v from embeddings), p as (
 select a.label, a.block, a.vec_id, round(list_distance(a.v, b.v), 9) as d from c a join c b on a.label = b.label and a.block = b.block), s as (
 select label, block, vec_id, quantile_cont(d, 0.5) as m, count(*) filter (d <= 1.4) as consistent, count(*) as n from p group by label, block, vec_id), r as (
 select *, row_number() over (partition by label, block order by m, vec_id) as k from s)
select label, block, vec_id, round(m, 6) as median_distance, consistent, n, consistent >= greatest(1, case when n > 1 then n // 2 + 1 else 1 end) as accepted from r where k = 1"""


def _rays(spark, d) -> DataFrame:
    """The first three parts of neighbouring vectors of a label as pairs of directions."""
    e = table(spark, d, "embeddings")
    part = lambda k, n: F.element_at("embedding", k).cast("double").alias(n)
    a = e.select("label", "vec_id", part(1, "ax"), part(2, "ay"), part(3, "az"))
    b = e.select("label", (F.col("vec_id") - 1).alias("vec_id"), part(1, "bx"), part(2, "by"), part(3, "bz")).drop("label")
    return a.join(b, "vec_id")


def kabsch_moments(spark, d) -> DataFrame:
    out = matching.moments(_rays(spark, d), ("ax", "ay", "az"), ("bx", "by", "bz"), "label")
    return out.select("label", "n", *[F.round(f"m{i}{j}", 6).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


KABSCH = "select a.label, count(*) as n, " + ", ".join(f"round(sum(a.embedding[{i + 1}]::double * b.embedding[{j + 1}]::double), 6) as m{i}{j}" for i in range(3) for j in range(3)) + " from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by a.label"


def kabsch_rotation(spark, d) -> DataFrame:
    """Directions and the same ones turned by 0.3 radians about z: the turn is found again."""
    r = _rays(spark, d)
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    turned = r.select("label", "ax", "ay", "az", (F.col("ax") * c - F.col("ay") * s).alias("bx"), (F.col("ax") * s + F.col("ay") * c).alias("by"), F.col("az").alias("bz"))
    out = matching.fit_rotations(turned, ("ax", "ay", "az"), ("bx", "by", "bz"), "label")
    return out.select("label", "n", *[(F.round(F.element_at("rotation", k + 1), 6) + 0.0).alias(f"r{k // 3}{k % 3}") for k in range(9)])


KABSCH_ROTATION = """select a.label, count(*) as n, round(cos(0.3::double), 6) as r00, round(-sin(0.3::double), 6) as r01, 0.0::double as r02, round(sin(0.3::double), 6) as r10, round(cos(0.3::double), 6) as r11, 0.0::double as r12,
 0.0::double as r20, 0.0::double as r21, 1.0::double as r22 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by a.label"""


def sector_log_ratio(spark, d) -> DataFrame:
    out = matching.sector_ratio(table(spark, d, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"], "l_quantity", "l_discount")
    return out.select("l_returnflag", "sector", "n", F.round("log_ratio", 6).alias("log_ratio"))


SECTOR = """with s as (select l_returnflag, ntile(32) over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 as sector, l_quantity as a, l_discount as b from lineitem), m as (
 select l_returnflag, sector, count(*) as n, quantile_cont(ln(b / a), 0.5) as m from s where a > 0 and b > 0 group by 1, 2)
select l_returnflag, sector::int as sector, n, round(case when n >= 16 then greatest(-0.6931471805599453, least(0.6931471805599453, m)) end, 6) as log_ratio from m"""


def audio_sample_windows(spark, d) -> DataFrame:
    """Windows of 48 kHz audio for frames at 30000/1001 a second, from orders' keys; video starts 1/20 s behind the sound."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 13).alias("first"), (F.col("o_custkey") % 90 + 1).alias("count"))
    num = lambda x: F.lit(x)
    start, end = C.audio_window(F.col("first"), F.col("count"), num(30000), num(1001), num(48000), num(1), num(20))
    return o.select("o_orderkey", start.alias("start"), end.alias("end"))


def _audio_sql(frame: str) -> str:
    top, over = f"((1::hugeint * 30000 + ({frame})::hugeint * 1001 * 20) * 48000)", "(30000::hugeint * 20)"
    return f"({top} // {over} + case when 2 * ({top} % {over}) > {over} or (2 * ({top} % {over}) = {over} and ({top} // {over}) % 2 = 1) then 1 else 0 end)::bigint"


AUDIO = f"""select o_orderkey, {_audio_sql("o_orderkey * 13")} as start, {_audio_sql("o_orderkey * 13 + o_custkey % 90 + 1")} as "end" from orders"""


def manifest_explode(spark, d) -> DataFrame:
    """Conversations as jobs of a manifest in JSON, read back and exploded in order."""
    c = table(spark, d, "conversations")
    jobs = c.groupBy("conv_id").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("jobs"))).alias("manifest"))
    read = jobs.select("conv_id", F.from_json("manifest", "schema_version int, jobs array<struct<turn:long,role:string,size:long>>").alias("m"))
    out = read.select("conv_id", F.posexplode("m.jobs").alias("position", "job"))
    return out.select("conv_id", F.col("position").cast("long").alias("position"), "job.turn", "job.role", "job.size")


MANIFEST = """select conv_id, row_number() over (partition by conv_id order by turn, role, length(text)) - 1 as position, turn, role, length(text) as size from conversations"""

def audio_contract(spark, d) -> DataFrame:
    """Events' properties as audio tracks: their count and rate decide."""
    rate = F.get_json_object("props", "$.k").cast("long")
    e = events(spark, d).withColumn("rate", rate)
    status = F.when(F.col("rate") == 0, "absent").when(F.col("rate") > 50, "too many").when((F.col("value") * 100).cast("long") % F.col("rate") == 0, "whole").otherwise("broken")
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


AUDIO_CONTRACT = f"""with {EVENTS}, e as (select json_extract_string(props, '$.k')::bigint as rate, trunc(value * 100)::bigint as v from ev)
select case when rate = 0 then 'absent' when rate > 50 then 'too many' when v % rate = 0 then 'whole' else 'broken' end as status, count(*) as n from e group by 1"""

QUERIES = {
    "contract_single_valued": contract_single_valued, "adapter_lookup_unknowns": adapter_lookup_unknowns, "mode_resolution": mode_resolution, "option_violations": option_violations,
    "resume_semi": resume_semi, "resume_anti": resume_anti, "path_collisions": path_collisions, "set_difference_fields": set_difference_fields, "edge_identity_hash": edge_identity_hash,
    "nearest2_ratio_test": nearest2_ratio_test, "medoid_consensus": medoid_consensus, "medoid_blocks": medoid_blocks, "kabsch_moments": kabsch_moments, "kabsch_rotation": kabsch_rotation,
    "sector_log_ratio_median": sector_log_ratio, "audio_sample_windows": audio_sample_windows, "manifest_explode": manifest_explode, "audio_contract": audio_contract,
}
ORACLES = {
    "contract_single_valued": SINGLE, "adapter_lookup_unknowns": ADAPTER, "mode_resolution": MODE, "option_violations": OPTIONS,
    "resume_semi": _RESUME.format(""), "resume_anti": _RESUME.format("not"), "path_collisions": COLLISIONS, "set_difference_fields": FIELDS, "edge_identity_hash": EDGE,
    "nearest2_ratio_test": NEAREST, "medoid_consensus": _medoid_sql(240), "medoid_blocks": _medoid_sql(120), "kabsch_moments": KABSCH, "kabsch_rotation": KABSCH_ROTATION,
    "sector_log_ratio_median": SECTOR, "audio_sample_windows": AUDIO, "manifest_explode": MANIFEST, "audio_contract": AUDIO_CONTRACT,
}
