"""Feature vectors of a stroke and similarities of two strokes, from the bundles of the other modules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import geometry, pairs, sequence, signature, spectral


def signature_features(levels: DataFrame) -> DataFrame:
    """``features``: eleven numbers of each stroke's signature levels."""
    c = F.col
    n = signature.signature_norm(levels)
    parts = [F.sqrt(c("s_x") * c("s_x") + c("s_y") * c("s_y")), F.atan2("s_y", "s_x"), c("s_xy") - c("s_yx"), c("s_xx") + c("s_yy"), c("s_xxx"), c("s_yyy"), c("s_xxy") + c("s_yyx"), c("variation"), c("norm"), F.log1p("norm"), F.when(c("variation") > 0, c("norm") / c("variation")).otherwise(0.0)]
    return n.select("stroke_id", F.array(*parts).alias("features"))


def knot_metrics(points: DataFrame) -> DataFrame:
    """One row per stroke: writhe, winding, turning, linking, entropy of the bends, and its crossings."""
    zero = lambda col: F.coalesce(col, F.lit(0))
    crossed = pairs.crossings(points).groupBy("stroke_id").agg(F.count("*").alias("n_crossings"), F.count_if(F.col("sign") > 0).alias("n_positive"), F.avg("angle").alias("mean_angle"))
    out = pairs.writhe(points).join(sequence.origin_winding(points), "stroke_id").join(sequence.total_turning(points), "stroke_id").join(geometry.geometric_complexity(points), "stroke_id").join(crossed, "stroke_id", "left")
    return out.select("stroke_id", "writhe", "winding", "total_turning", ((F.col("writhe") + F.col("winding")) / 2).alias("linking"), "entropy", F.lit(0.0).alias("chirality"), *(zero(F.col(n)).alias(n) for n in ("n_crossings", "n_positive", "mean_angle")))


def knot_features(metrics: DataFrame) -> DataFrame:
    n = F.col("n_crossings").cast("double")
    p = F.col("n_positive").cast("double")
    return metrics.select("stroke_id", F.array("writhe", "winding", "total_turning", "linking", "entropy", "chirality", n, n, p, n - p, F.col("mean_angle").cast("double"), 2 * p - n).alias("features"))


def spectral_metrics(points: DataFrame, size: int) -> DataFrame:
    """Moments, entropy of the wavelet levels, dominant frequencies and cepstral coefficients; ``size`` is the spectrum's."""
    signal = spectral.tangent_signal(points)
    power = spectral.spectrum(signal)
    listed = lambda df, key, value, name: df.groupBy("stroke_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]).alias(name))
    out = spectral.moments(power).join(listed(power, "k", "power", "power"), "stroke_id").join(listed(spectral.mfcc(power, size), "c", "value", "mfcc"), "stroke_id")
    shares = spectral.haar(signal)
    out = out.join(spectral.wavelet_entropy(shares), "stroke_id").join(listed(shares, "level", "share", "energy"), "stroke_id").join(listed(spectral.dominant(power), "place", "frequency", "dominant"), "stroke_id", "left")
    out = out.withColumn("dominant", F.coalesce("dominant", F.array().cast("array<double>")))
    complexity = 0.2 * (F.col("centroid") / F.size("power") + F.col("rolloff") + F.least(F.lit(1.0), F.abs("kurtosis") / 10) + F.col("entropy") + F.size("dominant") / 10)
    return out.withColumn("spectral_complexity", complexity)


def spectral_features(metrics: DataFrame) -> DataFrame:
    """25 numbers, padded with zeros."""
    pad = lambda c, n: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(0.0), n)), 1, n)
    head = F.array("centroid", "rolloff", "kurtosis", "spectral_complexity", F.size("dominant").cast("double"))
    return metrics.select("stroke_id", F.slice(F.concat(head, pad("dominant", 5), F.array("entropy"), F.slice("energy", 1, 3), F.slice("mfcc", 1, 8), F.array_repeat(F.lit(0.0), 25)), 1, 25).alias("features"))


def _apart(c: str) -> Column:
    return F.abs(F.col(c) - F.col(f"o_{c}"))


def knot_similarity() -> Column:
    parts = 0.2 * (1 - _apart("writhe") / 10) + 0.15 * (1 - _apart("winding") / 5) + 0.2 * (1 - _apart("total_turning") / (2 * math.pi)) + 0.15 * (1 - _apart("entropy") / 10) + 0.15 * (1 - _apart("chirality") / math.pi) + 0.15 * (1 - _apart("n_crossings") / 10)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts))


def topology_similarity() -> Column:
    """Of rows beside each other: the weighted differences of the Betti numbers are added before the sign is dropped."""
    loops = F.greatest(F.size("loops"), F.size("o_loops"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    differ = F.aggregate(F.zip_with("loops", "o_loops", lambda a, b: F.abs(zero(a) - zero(b))), F.lit(0.0), lambda s, v: s + v)
    differing = sum(((F.col(f"b{k}") - F.col(f"o_b{k}")) * (k + 1) for k in range(3)), F.lit(0))
    return 0.4 * (1 - F.abs(differing) / 10) + 0.3 * (1 - _apart("complexity") / (F.greatest("complexity", "o_complexity") + 1)) + 0.3 * F.when(loops > 0, 1 - differ / loops).otherwise(1.0)


def spectral_similarity() -> Column:
    size = F.least(F.size("power"), F.size("o_power"))
    spectra = F.coalesce(signature.cosine(F.slice("power", F.lit(1), size), F.slice("o_power", F.lit(1), size)), F.lit(0.0))
    far = F.sqrt(F.aggregate(F.zip_with("mfcc", "o_mfcc", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return 0.6 * spectra + 0.4 * F.exp(-far / 10)


def spatial_similarity() -> Column:
    return F.greatest(F.lit(0.0), 1 - (0.3 * _apart("separation") + 0.3 * _apart("spread")) / 10)


def stored_vector() -> Column:
    """The 53 numbers of a stored stroke, each block padded to its own slots; null counts as 0."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    block = lambda n, k: F.slice(F.concat(F.coalesce(F.col(n), F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), k)), 1, k)
    scalars = F.array(*map(zero, ("arc_length", "total_turning", "winding", "writhe", "complexity", "regularity", "symmetry", "stability")))
    return F.concat(scalars, block("level1", 10), block("log_signature", 20), F.array(zero("centroid"), zero("bandwidth")), block("mfcc", 13))


def landmarks(points: DataFrame) -> DataFrame:
    """Inflections (.8), maxima (.9) and both ends (1.0) of each stroke, with the place along it."""
    c = sequence.robust_curvature(points)
    last = points.groupBy("stroke_id").agg(F.max("i").alias("last"))
    ends = last.select("stroke_id", F.explode(F.array(F.lit(0), "last")).alias("point"), F.lit("endpoint").alias("kind"), F.lit(1.0).alias("stability"))
    bends = sequence.inflections(c).select("stroke_id", "point", F.lit("inflection").alias("kind"), F.lit(0.8).alias("stability"))
    tops = sequence.extrema(c).where("kind = 'maximum'").select("stroke_id", "point", F.lit("peak").alias("kind"), F.lit(0.9).alias("stability"))
    every = bends.unionByName(tops).unionByName(ends).join(last, "stroke_id")
    return every.select("stroke_id", "point", "kind", "stability", F.when(F.col("last") > 0, F.col("point") / F.col("last")).otherwise(0.0).alias("along"))


def stability_index(found: DataFrame) -> DataFrame:
    return found.groupBy("stroke_id").agg(F.avg("stability").alias("stability"), F.count("*").alias("n"), F.max_by("kind", "stability").alias("firmest"))


def paired(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (stroke_id, other) with the columns of the one's row as they are and of the other's under ``o_``: two equi-joins,
    so no label or group lands in one task."""
    renamed = rows.select(*(F.col(c).alias("other" if c == "stroke_id" else f"o_{c}") for c in rows.columns))
    return pairs.join(rows, "stroke_id").join(renamed, "other")


def series_similarity(a: Column, b: Column, most: int = 50) -> Column:
    """Absolute cosine of two series brought to one length, the shorter's or ``most``, by linear steps; 0 if either vanishes or
    is empty."""
    size = F.least(F.size(a), F.size(b), F.lit(most))

    def resampled(values: Column) -> Column:
        last = F.size(values) - 1

        def at(k: Column) -> Column:
            place = F.when(size > 1, k / F.nullif(size - 1, F.lit(0))).otherwise(0.0) * last
            low = F.floor(place).cast("int")
            return F.get(values, low) + (place - low) * (F.get(values, F.least(low + 1, last)) - F.get(values, low))

        return F.transform(F.sequence(F.lit(0), size - 1), at)

    return F.when(size > 0, F.coalesce(F.abs(signature.cosine(resampled(a), resampled(b))), F.lit(0.0))).otherwise(0.0)
