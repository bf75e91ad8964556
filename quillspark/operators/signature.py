"""Path signatures of a stroke: iterated sums over its increments, in one pass of window columns and one aggregation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.sequence import before, step, whole, with_steps


def normalised(points: DataFrame) -> DataFrame:
    """Centred on the mean of the points and divided by the path's length, if it has one."""
    length = F.sum(F.coalesce("ds", F.lit(0.0))).over(whole())
    out = with_steps(points).withColumns({"size": length, "mx": F.avg("x").over(whole()), "my": F.avg("y").over(whole())})
    scale = F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)
    return out.withColumns({"x": (F.col("x") - F.col("mx")) / scale, "y": (F.col("y") - F.col("my")) / scale}).drop("size", "mx", "my", "dx", "dy", "dt", "ds")


def _sum(value: Column, name: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0)).alias(name)


def levels(points: DataFrame) -> DataFrame:
    """``s_x .. s_yyy`` (levels 1 to 3) and ``s4_0 .. s4_15`` of each stroke; what has too few points is 0."""
    p = with_steps(points).withColumns({f"{c}{k}": before(c, k) for c in ("x", "y") for k in (1, 2, 3)} | {f"d{c}{k}": before(f"d{c}", k) for c in ("x", "y") for k in (1, 2)})
    col = F.col
    mid2 = {c: (col(f"{c}1") + col(c)) * 0.5 for c in "xy"}
    mid3 = {c: (col(f"{c}2") + col(f"{c}1") + col(c)) / 3 for c in "xy"}
    mid4 = {c: (col(f"{c}3") + col(f"{c}2") + col(f"{c}1") + col(c)) / 4 for c in "xy"}
    sums = [(F.max_by(c, "i") - F.min_by(c, "i")).alias(f"s_{c}") for c in "xy"]
    sums += [_sum(mid2[a] * col(f"d{b}"), f"s_{a}{b}") for a, b in product("xy", repeat=2)]
    sums += [_sum(mid3[a] * col(f"d{b}1") * col(f"d{c}"), f"s_{a}{b}{c}") for a, b, c in product("xy", repeat=3)]
    first, second, third = ({c: col(f"d{c}{suffix}") for c in "xy"} for suffix in ("2", "1", ""))
    words = ("xxxx", "xxxy", "xxyx", "xyxx", "yxxx", "xyyy", "yxyy", "yyxy", "yyyx", "yyyy")
    terms = [mid4[w[0]] * first[w[1]] * second[w[2]] * third[w[3]] for w in words]
    has = third["x"] * 0
    x4, y4 = mid4["x"], mid4["y"]
    terms += [x4 * x4 * first["x"] * first["y"], y4 * y4 * first["x"] * first["y"], x4 * y4 * first["x"] * second["x"], x4 * y4 * first["y"] * second["y"]]
    terms += [F.abs(first["x"] * second["y"] - first["y"] * second["x"]) + has, step(first["x"], first["y"]) * step(second["x"], second["y"]) + has]
    sums += [_sum(t, f"s4_{k}") for k, t in enumerate(terms)]
    sums += [_sum(col("ds") * col("ds"), "squares")]
    return p.groupBy("stroke_id").agg(*sums).withColumn("variation", F.sqrt("squares")).drop("squares")


def log_signature(found: DataFrame) -> DataFrame:
    """``found`` (of ``levels``) with ``log_signature``, 14 numbers."""
    col = F.col
    area = 0.5 * col("s_x") * col("s_y")
    two = [col("s_xx"), col("s_xy"), col("s_yx"), col("s_yy")]
    parts = [col("s_x"), col("s_y"), two[0], two[1] - area, two[2] + area, two[3]]
    for k, word in enumerate(product("xy", repeat=3)):
        parts.append(col("s_" + "".join(word)) + (1 / 12) * (col("s_x") if k < 4 else col("s_y")) * two[k % 2])
    return found.withColumn("log_signature", F.array(*parts))


def signature_norm(found: DataFrame) -> DataFrame:
    names = [f"s_{''.join(w)}" for n in (1, 2, 3) for w in product("xy", repeat=n)]
    return found.withColumn("norm", F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; null where either is zero."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def compare(pairs: DataFrame) -> DataFrame:
    """``similarity`` of the rows' ``log_a`` and ``log_b``: their absolute cosine, 0 if either vanishes."""
    return pairs.withColumn("similarity", F.coalesce(F.abs(cosine(F.col("log_a"), F.col("log_b"))), F.lit(0.0)))


def path_signature(points: DataFrame) -> DataFrame:
    """All levels of each stroke as arrays, with the logarithmic signature, the variation and the norm, in one bundle."""
    found = signature_norm(log_signature(levels(normalised(points))))
    listed = [F.array(*(F.col("s_" + "".join(w)) for w in product("xy", repeat=n))).alias(f"level{n}") for n in (1, 2, 3)]
    return found.select("stroke_id", *listed, F.array(*(F.col(f"s4_{k}") for k in range(16))).alias("level4"), "log_signature", "variation", "norm")
