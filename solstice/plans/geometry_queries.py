"""Lens and sphere geometry, raster weights and recordings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lens as L
from ..operators import consensus, gps, matching, raster
from .tables import DAY, SERIES, events, table

LENS = L.Lens(1.5, 90.0, 90.0, 63.5, 63.5, 128, (0.02, -0.005, 0.001, -0.002, 0.0005))
WIDTH, HEIGHT = 128, 64
#: The grid's rays in SQL.
_GRID = f"""g as (select o_orderkey as id, (o_custkey % {HEIGHT})::int as row, (o_orderkey % {WIDTH})::int as col from orders), a as (
 select *, ((col + 0.5::double) / {WIDTH} - 0.5::double) * (2 * 3.141592653589793::double) as lon, (0.5::double - (row + 0.5::double) / {HEIGHT}) * 3.141592653589793::double as lat from g), r as (
 select id, row, col, cos(lat) * cos(lon) as x, cos(lat) * sin(lon) as y, sin(lat) as z from a)"""


def _grid(spark, d) -> DataFrame:
    """Orders as pixels of a sphere."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % HEIGHT).cast("int").alias("row"), (F.col("o_orderkey") % WIDTH).cast("int").alias("col"))



def _lens_sql(name: str, of: str, x: str, y: str, z: str, lens: L.Lens) -> str:
    """name: of's columns with u, v and ok of a projection."""
    k1, k2, p1, p2, k3 = (f"{k!r}::double" for k in lens.distortion)
    gate = f"and {z} > {-1.0 / lens.xi!r}::double" if lens.xi > 0 else ""
    return f"""{name}_p as (select *, ({z}) + {lens.xi!r}::double as dep, case when ({z}) + {lens.xi!r}::double > 0 {gate} then ({x}) / (({z}) + {lens.xi!r}::double) end as px,
 case when ({z}) + {lens.xi!r}::double > 0 {gate} then ({y}) / (({z}) + {lens.xi!r}::double) end as py from {of}), {name}_r as (select *, px * px + py * py as rr from {name}_p), {name}_d as (
 select *, px * (1 + rr * ({k1} + rr * ({k2} + rr * {k3}))) + 2 * {p1} * px * py + {p2} * (rr + 2 * px * px) as dx,
 py * (1 + rr * ({k1} + rr * ({k2} + rr * {k3}))) + {p1} * (rr + 2 * py * py) + 2 * {p2} * px * py as dy from {name}_r), {name}_u as (
 select *, {lens.fx!r}::double * dx + {lens.cx!r}::double as uu, {lens.fy!r}::double * dy + {lens.cy!r}::double as vv from {name}_d), {name} as (
 select *, coalesce(uu >= 0 and vv >= 0 and uu < {lens.width - 1} and vv < {lens.width - 1}, false) as ok from {name}_u)"""


def equirect_rays(spark, d) -> DataFrame:
    g = _grid(spark, d).withColumn("r", L.pixel_ray(F.col("col"), F.col("row"), WIDTH, HEIGHT))
    return g.select("id", "row", "col", *[F.round(F.col(f"r.{c}"), 9).alias(c) for c in "xyz"])


RAYS = f"with {_GRID} select id, row, col, round(x, 9) as x, round(y, 9) as y, round(z, 9) as z from r"


def lens_project(spark, d) -> DataFrame:
    g = _grid(spark, d).withColumn("r", L.pixel_ray(F.col("col"), F.col("row"), WIDTH, HEIGHT))
    p = g.withColumn("p", L.project(LENS, F.col("r.x"), F.col("r.y"), F.col("r.z")))
    return p.select("id", "row", "col", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"), "p.valid")


PROJECT = f"with {_GRID}, {_lens_sql('q', 'r', 'x', 'y', 'z', LENS)} select id, row, col, round(case when ok then uu end, 6) as u, round(case when ok then vv end, 6) as v, ok as valid from q"

C13 = [0.02, -0.01, 0.004, -0.001, 0.0005, 0.003, -0.002, 0.001, 0.0005, 0.002, -0.001, 0.0004, 0.0002]


def v6_distort(spark, d) -> DataFrame:
    """Lines as points."""
    c = F.col
    g = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_quantity") / 25 - 1).alias("x"), (c("l_discount") * 20 - 1).alias("y"))
    p = g.withColumn("p", L.distort13(F.col("x"), F.col("y"), [F.lit(c) for c in C13]))
    return p.select("id", F.round("p.x", 9).alias("dx"), F.round("p.y", 9).alias("dy"))


_C = [f"{c!r}::double" for c in C13]
DISTORT = f"""with g as (select l_orderkey * 10 + l_linenumber as id, l_quantity / 25 - 1 as x, l_discount * 20 - 1 as y from lineitem), r as (
 select *, x * x + y * y as r from g), t as (select *, 1 + {_C[0]} * r + {_C[1]} * r ** 2 + {_C[2]} * r ** 3 + {_C[3]} * r ** 4 + {_C[4]} * r ** 5 as rad, {_C[5]} + {_C[7]} * r as a, {_C[6]} + {_C[8]} * r as b from r)
select id, round(x * rad + a * (r + 2 * x * x) + 2 * b * x * y + {_C[9]} * r + {_C[11]} * r * r, 9) as dx, round(y * rad + b * (r + 2 * y * y) + 2 * a * x * y + {_C[10]} * r + {_C[12]} * r * r, 9) as dy from t"""


def undistort_roundtrip(spark, d) -> DataFrame:
    """Pixels to rays and back: what is missed by more than a millionth of a pixel."""
    g = table(spark, d, "orders").select((F.col("o_orderkey") % 1259 / 10).alias("u"), (F.col("o_custkey") % 1259 / 10).alias("v"))
    back = L.unproject(g, LENS, "u", "v", "r").withColumn("p", L.project(LENS, F.col("r.x"), F.col("r.y"), F.col("r.z")))
    miss = F.greatest(F.abs(F.col("p.u") - F.col("u")), F.abs(F.col("p.v") - F.col("v")))
    return back.agg(F.count_if("p.valid").alias("pixels"), F.count_if(miss > 1e-6).alias("missed"))


FRONT, BACK = L.Lens(1.5, 80.0, 80.0, 63.5, 63.5, 128), L.Lens(1.5, 80.0, 80.0, 63.5, 63.5, 128)


def visibility_weights(spark, d) -> DataFrame:
    out = raster.two_lens_weights(_grid(spark, d), WIDTH, HEIGHT, FRONT, BACK)
    return out.select("id", "row", "col", F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"), "covered")


_WEIGHTS = f"""{_GRID}, {_lens_sql('f', 'r', 'x', 'y', 'z', FRONT)}, f2 as (select id, row, col, x, y, z, ok as ok0 from f), {_lens_sql('b', 'f2', 'x', '-y', '-z', BACK)}, w as (
 select id, row, col, greatest(0.0, least(1.0, (z + 0.1::double) / 0.2::double)) * ok0::int as a, greatest(0.0, least(1.0, (-z + 0.1::double) / 0.2::double)) * ok::int as b from b)"""
WEIGHTS = f"with {_WEIGHTS} select id, row, col, round(a / nullif(a + b, 0), 6) as w0, round(b / nullif(a + b, 0), 6) as w1, a + b > 1e-5 as covered from w"


def coverage_missing_fraction(spark, d) -> DataFrame:
    return raster.missing_fraction(raster.two_lens_weights(_grid(spark, d), WIDTH, HEIGHT, FRONT, BACK))


COVERAGE = f"""with {_WEIGHTS} select count(*) as pixels, count(*) filter (not a + b > 1e-5) as missing, count(*) filter (not a + b > 1e-5) / count(*)::double as fraction,
 count(*) filter (not a + b > 1e-5) / count(*)::double <= 0.001 as accepted from w"""


def visibility_fallback(spark, d) -> DataFrame:
    """Lines as pixels: preference, eligibility and quality of two lenses from their numbers."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("p"), F.col("l_tax").alias("t"))
    e0, e1 = (F.col("p") > 0.02).cast("double"), (F.col("t") > 0.02).cast("double")
    a, b = raster.visibility_pair((F.col("p") > 0.05).cast("double"), e0, F.col("q"), (F.col("t") > 0.05).cast("double"), e1, 1.1 - F.col("q"))
    return li.select("line", F.round(a, 6).alias("w0"), F.round(b, 6).alias("w1"))


FALLBACK = """with l as (select l_orderkey * 10 + l_linenumber as line, l_quantity / 50 as q, (l_discount > 0.02::double)::int::double as e0, (l_tax > 0.02::double)::int::double as e1, (l_discount > 0.05::double)::int::double as p0, (l_tax > 0.05::double)::int::double as p1 from lineitem), w as (
 select line, case when p0 * e0 + p1 * e1 <= 1e-6 then e0 * q else p0 * e0 end as a, case when p0 * e0 + p1 * e1 <= 1e-6 then e1 * (1.1::double - q) else p1 * e1 end as b from l)
select line, round(a / nullif(a + b, 0), 6) as w0, round(b / nullif(a + b, 0), 6) as w1 from w"""


def ransac_rotation(spark, d) -> DataFrame:
    """Directions of each label and the same ones turned, a quarter of them wrong: a robust fit per label and block of 500 ids, as of a frame pair."""
    e = table(spark, d, "embeddings")
    x, y, z = (F.element_at("embedding", k).cast("double") for k in (1, 2, 3))
    n = F.sqrt(x * x + y * y + z * z)
    e = e.where(n > 0).select("label", F.floor(F.col("vec_id") / 500).alias("block"), "vec_id", (x / n).alias("ax"), (y / n).alias("ay"), (z / n).alias("az"))
    c, s, wrong = math.cos(0.4), math.sin(0.4), F.col("vec_id") % 4 == 0
    pairs = e.select("label", "block", "ax", "ay", "az", F.when(wrong, F.col("az")).otherwise(F.col("ax") * c - F.col("ay") * s).alias("bx"), F.when(wrong, F.col("ax")).otherwise(F.col("ax") * s + F.col("ay") * c).alias("by"), F.when(wrong, F.col("ay")).otherwise(F.col("az")).alias("bz"))
    return consensus.robust_rotations(pairs, ["label", "block"])


def closed_path_dp(spark, d) -> DataFrame:
    """Parts as cost grids of 8 rows and 24 columns: the cheapest ring of each brand."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    cells = p.withColumn("cell", F.col("p_partkey") % 192)
    costs = cells.groupBy("p_brand", "cell").agg(F.min("p_retailprice").alias("cost"))
    grid = p.select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(0), F.lit(191))).alias("cell"))
    full = grid.join(costs, ["p_brand", "cell"], "left").select("p_brand", (F.col("cell") / 24).cast("int").alias("row"), (F.col("cell") % 24).cast("int").alias("col"), (F.coalesce("cost", F.lit(1000.0)) / 1000).alias("cost"))
    return raster.seam_paths(full, "p_brand")


def gpx_document(spark, d) -> DataFrame:
    """Events as positions: a document per user."""
    e = events(spark, d)
    samples = e.select(
        F.col("user_id").cast("string").alias("source"), F.row_number().over(SERIES.window).cast("long").alias("sample"), F.floor(F.col("us") / 1_000_000).alias("utc_s"), (F.floor(F.col("us") / 1000) % 1000).cast("int").alias("ms"),
        F.when(F.col("event_type") == "error", "V").otherwise("A").alias("fix"), F.lit("N").alias("ns"), F.lit("E").alias("ew"), (F.col("value") / 2).alias("lat"), (F.col("value") / 3).alias("lon"),
        F.col("value").alias("speed"), F.lit(90.0).alias("course"), F.lit(float("nan")).alias("alt"),
    )
    return gps.gpx(gps.positions(samples, DAY / 1e6))


QUERIES = {
    "lens_project": lens_project, "v6_distort": v6_distort, "equirect_rays": equirect_rays, "undistort_roundtrip": undistort_roundtrip, "ransac_rotation": ransac_rotation,
    "closed_path_dp": closed_path_dp, "coverage_missing_fraction": coverage_missing_fraction, "visibility_weights": visibility_weights, "visibility_fallback": visibility_fallback,
    "gpx_document": gpx_document,
}
ORACLES = {
    "lens_project": PROJECT, "v6_distort": DISTORT, "equirect_rays": RAYS, "coverage_missing_fraction": COVERAGE, "visibility_weights": WEIGHTS, "visibility_fallback": FALLBACK,
}
