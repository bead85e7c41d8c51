"""Gates before a job: what a profile, a mode, a range or a review must say. Each gives violations as rows or a condition as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import finite, within_relative
from .contracts import violations
from .inspection import proper_rotation
from .quantiles import exact_quantiles

#: Modes whose frames belong together or whose clock differs from playback.
RETIMED, GROUPED = ("timelapse", "slow-motion"), ("hdr-photo", "aeb-photo", "burst-photo", "interval-photo", "stack-photo")


def bias_limit_radians() -> float:
    """The largest gyro bias of a profile: five degrees a second."""
    return 5 * 3.141592653589793 / 180


def mode_refusal(mode: Column, kind: str) -> Column:
    """Why a recording mode can't be exported as `kind`; null if it can."""
    return (
        F.when(mode.isin(f"standard-{kind}", "unspecified"), None).when(mode.isin(*RETIMED), "retimed").when(mode.isin(*GROUPED), "grouped").otherwise("not qualified")
    )


def colour_refusal(hdr_state: Column, hdr_mode: Column, ultra_hdr: Column, bit_depth: Column) -> Column:
    """Whether a recording declares a high dynamic range or a higher bit depth; what is not declared is 0."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return (zero(hdr_state) != 0) | ~zero(hdr_mode).isin(0, 1) | (zero(ultra_hdr) != 0) | ~zero(bit_depth).isin(0, 1)


def fingerprint_text(x: Column) -> Column:
    """Whether a text is a SHA-256 in lower-case hexadecimal digits."""
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def calibration_violations(profiles: DataFrame) -> DataFrame:
    """(profile, rule): profile, schema int, frame_clock, camera, fingerprint, recording_fingerprint (null: not asked), rotation array<double>."""
    clock = F.coalesce("frame_clock", F.lit("nominal"))
    return violations(
        profiles, "profile",
        {
            "schema": F.col("schema").isin(1, 2, 3, 4),
            "frame clock": F.when(F.col("schema") == 1, clock == "nominal").when(F.col("schema") == 2, clock == "exposure-midpoint-v1").otherwise(True),
            "camera": F.col("camera").isNotNull() & (F.length("camera") > 0),
            "fingerprint": fingerprint_text(F.col("fingerprint")),
            "rotation": proper_rotation(F.col("rotation")),
            "recording": F.col("recording_fingerprint").isNull() | (F.col("recording_fingerprint") == F.col("fingerprint")),
        },
    )


def gyro_violations(profiles: DataFrame) -> DataFrame:
    """(profile, rule): profile, schema int, kind, fingerprint, recording_fingerprint, rotation array<double>, bias array<double> (radians a second), shift double (seconds)."""
    norm = F.sqrt(F.aggregate("bias", F.lit(0.0), lambda s, x: s + x * x))
    return violations(
        profiles, "profile",
        {
            "schema": (F.col("schema") == 1) & (F.col("kind") == "rigid-gyro"),
            "recording": F.col("recording_fingerprint") == F.col("fingerprint"),
            "rotation": proper_rotation(F.col("rotation")),
            "bias": (F.size("bias") == 3) & F.forall("bias", finite) & (norm <= bias_limit_radians()),
            "shift": finite(F.col("shift")) & (F.abs("shift") <= 0.06),
        },
    )


def same_timing(fps: Column, mode_fps: Column, readout: Column, mode_readout: Column) -> Column:
    """Whether a timing fit belongs to a recording: the same rate as text, readout within 1 % and a microsecond."""
    return F.coalesce((fps == mode_fps) & within_relative(readout, mode_readout, 0.01, 1e-6), F.lit(False))


def covered(begin: Column, end: Column, first: Column, last: Column, readout: Column) -> Column:
    """Whether a stream from first to last covers the range and half a readout at both ends."""
    return F.coalesce((begin - readout / 2 >= first) & (end + readout / 2 <= last), F.lit(False))


def row_track_violations(tracks: DataFrame) -> DataFrame:
    """(track, rule): track, rows array<struct<x,y,z,w>>: 3 to 257 unit quaternions, each on the side of the one before."""
    unit = F.forall("rows", lambda q: F.coalesce(F.abs(F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w) - 1) <= 1e-4, F.lit(False)))
    pairs = F.zip_with(F.slice("rows", F.lit(1), F.size("rows") - 1), F.slice("rows", F.lit(2), F.size("rows")), lambda a, b: a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w)
    return violations(tracks, "track", {"rows": F.size("rows").between(3, 257), "unit": unit, "continuous": (F.size("rows") < 2) | F.forall(pairs, lambda d: d > 0)})


def frame_range(df: DataFrame, first: int, count: int | None, frame: str = "frame", every: int = 1) -> DataFrame:
    """The frames from `first` on, `count` of them (all if None), and of those each whose number divides by `every`."""
    if first < 0 or count is not None and count < 1 or every < 1:
        raise ValueError("a range begins at 0 or later, has a frame at least, and steps of 1 at least")
    out = df.where(F.col(frame) >= first)
    out = out if count is None else out.where(F.col(frame) < first + count)
    return out.where(F.col(frame) % every == 0)


def crop_violations(lenses: DataFrame) -> DataFrame:
    """(lens, rule): lens, guard int, edited boolean, height, src_width, src_height, dst_width, dst_height, width: guards off, unedited, a centred even square crop."""
    c = F.col
    return violations(
        lenses, "lens",
        {
            "guards off": c("guard") == 3,
            "unedited": ~c("edited"),
            "square": (c("src_width") == c("src_height")) & (c("src_width") == c("height")) & (c("dst_width") == c("dst_height")),
            "width": (c("width") >= 32) & (c("width") <= c("dst_width")) & (c("dst_width") <= c("height")),
            "centred": F.pmod(c("height") - c("dst_width"), F.lit(2)) == 0,
        },
    )


def review_violations(proposals: DataFrame) -> DataFrame:
    """(proposal, rule): proposal, status, notes: only what was reviewed, with notes, may be used."""
    known = F.col("status").isin("needs_review", "reviewed")
    return violations(proposals, "proposal", {"status": known, "reviewed": ~known | (F.col("status") == "reviewed"), "notes": (F.col("status") != "reviewed") | F.col("notes").isNotNull()})


def approve(proposals: DataFrame, notes: DataFrame) -> DataFrame:
    """(proposal, status, notes, fingerprint): the proposals that wait for a review and get notes of 8 to 4000 characters become reviewed.

    The fingerprint is of the document that was reviewed; others stay as they are. proposals: proposal, status, notes, document. notes: proposal, text.
    """
    text = F.trim("text")
    out = proposals.join(notes, "proposal", "left")
    good = F.coalesce((F.col("status") == "needs_review") & F.length(text).between(8, 4000), F.lit(False))
    return out.select(
        "proposal", F.when(good, "reviewed").otherwise(F.col("status")).alias("status"), F.when(good, text).otherwise(F.col("notes")).alias("notes"), F.when(good, F.sha2(F.col("document").cast("binary"), 256)).alias("fingerprint")
    )


def migrated(old: DataFrame, columns: list[str]) -> DataFrame:
    """Profiles of the first schema with the columns that stay, and the marks of a migrated one; those with another clock or a later schema are left out."""
    fit = (F.coalesce("frame_clock", F.lit("nominal")) == "nominal") & ~F.coalesce("schema", F.lit(1)).isin(2, 3)
    return old.where(fit).select(*columns, F.lit(1).alias("schema"), F.lit("experimental").alias("quality_status"))


def changed(before: DataFrame, after: DataFrame, source: str, identity: str) -> DataFrame:
    """(source, before, after): the sources whose identity differs, or that came or went."""
    a, b = before.select(source, F.col(identity).alias("before")), after.select(source, F.col(identity).alias("after"))
    return a.join(b, source, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def bound(profiles: DataFrame, recordings: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """recordings with status: `bound` if a recording has a profile of its fingerprint, `foreign` if its profile has another, `missing` without one."""
    p = profiles.select(key, F.col(fingerprint).alias("_p"))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("_p") == F.col(fingerprint), "bound").otherwise("foreign")
    return recordings.join(p, key, "left").withColumn("status", status).drop("_p")


def paired(first: DataFrame, second: DataFrame, source: str, frame: str, value: str) -> DataFrame:
    """(source, frame, first, second): frames of two tracks of a source by position, for sources whose tracks have the same first frame and as many."""
    a, b = (x.groupBy(source).agg(F.min(frame).alias(f"_f{k}"), F.count("*").alias(f"_n{k}")) for k, x in enumerate((first, second)))
    alike = a.join(b, source).where("_f0 = _f1 and _n0 = _n1").select(source)
    both = first.select(source, frame, F.col(value).alias("first")).join(second.select(source, frame, F.col(value).alias("second")), [source, frame])
    return both.join(alike, source, "left_semi")


def paired_or_why(first: DataFrame, second: DataFrame, source: str, frame: str, value: str) -> DataFrame:
    """paired() with status `paired`, and a row without a frame for each source that has no pairs: `one track`, `other start` or `other length`."""
    a, b = (x.groupBy(source).agg(F.min(frame).alias(f"_f{k}"), F.count("*").alias(f"_n{k}")) for k, x in enumerate((first, second)))
    both = a.join(b, source, "full")
    why = F.when(F.col("_n0").isNull() | F.col("_n1").isNull(), "one track").when(F.col("_f0") != F.col("_f1"), "other start").when(F.col("_n0") != F.col("_n1"), "other length")
    pairs = paired(first, second, source, frame, value).withColumn("status", F.lit("paired"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema if f.name not in (source, "status")]
    return pairs.unionByName(both.withColumn("status", why).where("status is not null").select(source, *none, "status"))


def round_trips(tracks: DataFrame, width: int, height: int, limit: float = 0.6, border: float = 2.0) -> DataFrame:
    """The tracks (x, y, there_x, there_y, back_x, back_y) that come back to within `limit` pixels and whose other end is inside the border."""
    c = F.col
    back = F.sqrt((c("back_x") - c("x")) ** 2 + (c("back_y") - c("y")) ** 2)
    inside = (c("there_x") >= border) & (c("there_x") < width - border) & (c("there_y") >= border) & (c("there_y") < height - border)
    return tracks.where(finite(c("there_x")) & finite(c("there_y")) & F.coalesce(back < limit, F.lit(False)) & inside)


def clock_report(exposures: DataFrame, videos: DataFrame) -> DataFrame:
    """Per source: the record of frame 0, mapped frames, least and largest residual to the nominal clock, and status.

    exposures: source, sample, us, seconds. videos: source, origin_us, fps double, frames long. The clock counts from the one record at exactly the
    origin. Status: ok; origin (no or several such records); coverage (fewer records behind it than frames); order (times that do not increase,
    or exposures beyond 1.01 frames); cadence (a step of more than 1.1 frames).
    """
    w = W.partitionBy("source").orderBy("sample")
    rows = exposures.join(videos, "source").withColumn("_step", F.col("us") - F.lag("us").over(w))
    zero = F.col("us") == F.col("origin_us")
    rows = rows.withColumn("_zero", F.min(F.when(zero, F.col("sample"))).over(W.partitionBy("source")))
    ordinal = F.col("sample") - F.col("_zero")
    mapped = (ordinal >= 0) & (ordinal < F.col("frames"))
    residual = F.when(mapped, (F.col("us") - F.col("origin_us")) / 1e6 - ordinal / F.col("fps"))
    out = rows.groupBy("source").agg(
        F.first("_zero").alias("first_record"), F.count_if(mapped).alias("mapped"), F.min(residual).alias("least_residual"), F.max(residual).alias("largest_residual"), F.count_if(zero).alias("_zeros"), F.first("frames").alias("_frames"),
        F.count_if((F.col("_step") <= 0) | ~finite(F.col("seconds")) | (F.col("seconds") <= 0) | (F.col("seconds") > 1.01 / F.col("fps"))).alias("_bad"),
        F.count_if(mapped & (ordinal > 0) & (F.col("_step") > 1.1e6 / F.col("fps"))).alias("_gaps"),
    )
    status = F.when(F.col("_zeros") != 1, "origin").when(F.col("mapped") < F.col("_frames"), "coverage").when(F.col("_bad") > 0, "order").when(F.col("_gaps") > 0, "cadence").otherwise("ok")
    return out.withColumn("status", status).drop("_zeros", "_frames", "_bad", "_gaps")


def view_summary(views: DataFrame) -> DataFrame:
    """Per source: samples, first and last second, gaps over 250 ms, and the extent of the recorded fields; views: source, sample, t, fov_x, fov_y."""
    step = F.col("t") - F.lag("t").over(W.partitionBy("source").orderBy("sample"))
    return views.withColumn("_step", step).groupBy("source").agg(
        F.count("*").alias("samples"), F.min("t").alias("first_seconds"), F.max("t").alias("last_seconds"), F.count_if(F.col("_step") > 0.25).alias("gaps"),
        *[f(c).alias(f"{n}_{c}") for c in ("fov_x", "fov_y") for n, f in (("least", F.min), ("largest", F.max))],
    )


def vector_rms(x: Column, y: Column, z: Column) -> Column:
    """An aggregate: degrees of the root of the mean squared length of vectors in radians."""
    return F.degrees(F.sqrt(F.avg(x * x + y * y + z * z)))


def block_scores(residuals: DataFrame, split: str, length: str) -> DataFrame:
    """Per split: n, median and p95 of the residuals (chords of the unit sphere) as angles in degrees; null ones are not counted, and a split of any size is no single buffer."""
    angle = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.col(length) / 2)))
    out = exact_quantiles(residuals, [split], angle, [0.5, 0.95])
    return out.select(split, "n", F.get("q", F.lit(0)).alias("median_degrees"), F.get("q", F.lit(1)).alias("p95_degrees"))


def seam_report(frames: DataFrame, source: str) -> DataFrame:
    """Per source: frames, mean trusted part of the seam, frames with any, and over those the mean residuals before and after.

    frames: source, trusted, middle (pixels), before, after (mean differences over trusted pixels; null without any).
    """
    part = F.col("trusted") / F.greatest(F.lit(1), F.col("middle"))
    some = F.col("trusted") > 0
    return frames.groupBy(source).agg(
        F.count("*").alias("frames"), F.avg(part).alias("confident"), F.count_if(some).alias("measured"), F.avg(F.when(some, F.col("before"))).alias("residual_before"), F.avg(F.when(some, F.col("after"))).alias("residual_after"),
        F.max(1 - part).alias("uncovered"),
    )


def obstruction_statistics(pixels: DataFrame, *place: str) -> DataFrame:
    """Per pixel over time: n, median and dark decile of the value, median distance from the median, median excess of the other lens, and how often it exceeds 0.06.

    pixels: the columns place, value, other. Two passes: the median is joined to the values.
    """
    first = pixels.groupBy(*place).agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.1)).alias("dark"))
    more = F.col("other") - F.col("value")
    second = pixels.join(first, list(place)).groupBy(*place).agg(F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).alias("variation"), F.percentile(more, F.lit(0.5)).alias("excess"), F.avg((more > 0.06).cast("double")).alias("persistence"))
    return first.join(second, list(place))


def overlap_consensus_input(fits: DataFrame) -> DataFrame:
    """The fits (inliers, valid, p95) good enough for a consensus: 30 inliers at least, half of the valid pairs, and a p95 of 1.2 degrees at most."""
    return fits.where((F.col("inliers") >= 30) & (2 * F.col("inliers") >= F.col("valid")) & (F.col("p95") <= 1.2))


def planned_frames(videos: DataFrame, source: str = "source") -> DataFrame:
    """(source, frame): the frames from which an alignment is taken: first_frame, and those a second and three seconds later, the last frame at most.

    Where fewer than three are left, those a second, three seconds and first_frame before it join them one by one. videos: source, first_frame, frames, fps.
    """
    first, last = F.col("first_frame"), F.col("frames") - 1
    second, third = (F.rint(F.col("fps") * s).cast("long") for s in (1, 3))
    picked = F.array_distinct(F.array(*[F.least(last, first + n) for n in (F.lit(0), second, third)]))
    for back in (second, third, first):
        earlier = F.greatest(F.lit(0), first - back).cast("long")
        picked = F.when(F.size(picked) < 3, F.array_union(picked, F.array(earlier))).otherwise(picked)
    return videos.select(source, F.explode(F.array_sort(picked)).alias("frame"))


def thinned(df: DataFrame, source: str, order: str, about: int = 120) -> DataFrame:
    """Every k-th row of a source in order, k such that about so many stay: n // about, 1 at least."""
    w = W.partitionBy(source)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / about))
    return df.withColumn("_k", k).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).where("_i % _k = 0").drop("_k", "_i")


def first_rows(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The first n rows of each source."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(source).orderBy(order))).where(F.col("_i") <= n).drop("_i")


def sample_list(values: Column) -> Column:
    """An array's distinct values in order."""
    return F.array_sort(F.array_distinct(values))


def different_sets(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, side): what only one of two sets of a group has; no rows if they are equal."""
    a, b = a.select(group, item).distinct(), b.select(group, item).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def frame_numbers(text: Column) -> Column:
    """array<long> of whole numbers of 0 or more joined by commas, blanks around them ignored; null if a part is none."""
    numbers = F.transform(F.split(text, ",", -1), lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("long")))
    return F.when(F.forall(numbers, lambda x: F.coalesce(x >= 0, F.lit(False))), numbers)


def script_json(text: Column) -> Column:
    """JSON that may stand in a page's script: no `<` in it."""
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))


def attribute_text(text: Column) -> Column:
    """A text that may stand in a quoted attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def url_path(text: Column) -> Column:
    """A text as part of a URL's path: UTF-8 bytes but letters, digits, `_.-~` and `/` as %XX."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def suffix_allowed(path: Column, profile: Column, suffixes: dict[str, tuple[str, ...]]) -> Column:
    """Whether a path's suffix, in any case, is one of its profile's."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(False)
    for name, allowed in suffixes.items():
        out = F.when(profile == name, suffix.isin(*allowed)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def identifier(text: Column) -> Column:
    """Whether a text is 1 to 64 ASCII letters, digits and underscores, not underscores alone."""
    return F.coalesce(text.rlike("^[A-Za-z0-9_]{1,64}$") & text.rlike("[A-Za-z0-9]"), F.lit(False))


def named_fields(fields: DataFrame, names: dict[int, str]) -> DataFrame:
    """(source, fields map<string,long>): the numbers of known fields of a message by name; of a repeated field the last; fields: source, position, number, value."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    last = fields.where(F.col("value").isNotNull() & F.col("number").isin(*names)).groupBy("source", "number").agg(F.max_by("value", "position").alias("value"))
    return last.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.element_at(name, F.col("number")).alias("k"), "value")))).alias("fields"))


def trimmed(df: DataFrame, source: str, t: str, first: Column, last: Column, start: float = 30.0, margin: float = 5.0, every: int = 5, order: str | None = None) -> DataFrame:
    """Every fifth row of what is later than `start` seconds and `margin` away from both ends of the coverage."""
    inside = df.where((F.col(t) > F.greatest(F.lit(start), first + margin)) & (F.col(t) < last - margin))
    return inside.withColumn("_i", F.row_number().over(W.partitionBy(source).orderBy(order or t)) - 1).where(F.col("_i") % every == 0).drop("_i")


def anchor_times(spans: DataFrame, step: float, source: str = "source") -> DataFrame:
    """(source, t): times from `first` on in steps, all before `last`, and `last`; each is first plus a whole multiple of the step."""
    n = F.ceil((F.col("last") - F.col("first")) / step - 1e-9).cast("long")
    at = F.concat(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: F.col("first") + k * step), F.array("last"))
    return spans.select(source, F.explode(F.array_distinct(at)).alias("t"))


def row_times(frames: DataFrame, center: str, readout: float, rows: int = 33) -> DataFrame:
    """frames with row and t: the times of so many equally spaced rows across a readout centred on the frame's."""
    if not 0 < readout <= 0.1 or rows < 2:
        raise ValueError("a readout takes up to a tenth of a second, and a track has two rows at least")
    out = frames.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return out.withColumn("t", F.col(center) + (F.col("row") / (rows - 1) - 0.5) * readout)


#: Fixed values of the format: the fields of a recording's metadata that occur once, by wire type.
SINGULAR = {2: (2, 3, 4, 5, 19, 22, 26, 27, 31, 53, 54, 56, 65), 0: (15, 20, 24, 29, 40, 42, 43, 62, 97, 153, 175, 203, 208), 1: (25, 28)}


def metadata_violations(fields: DataFrame, singular: dict[int, tuple[int, ...]] | None = None) -> DataFrame:
    """(source, number, rule): known fields that occur `twice`, or of another `wire type`; fields that are not known may be anything.

    fields: source, number, wire, as trailer.metadata_fields() or the data source's `metadata` give them. A field may break both rules.
    """
    wires = F.create_map(*[F.lit(x) for wire, numbers in (singular or SINGULAR).items() for n in numbers for x in (n, wire)])
    known = fields.withColumn("_wire", F.try_element_at(wires, F.col("number").cast("int"))).where("_wire is not null")
    of = known.groupBy("source", "number").agg(F.count("*").alias("n"), F.bool_or(F.col("wire") != F.col("_wire")).alias("other"))
    rules = F.array_compact(F.array(F.when(F.col("n") > 1, "twice"), F.when(F.col("other"), "wire type")))
    return of.select("source", "number", F.explode(rules).alias("rule"))
