from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from support import database, rows

from quillspark.operators import spectral
from quillspark.plans import all_queries, all_sql

#: Two pairs of mirrored maxima of this vector's spectrum fall on both sides of a rounding at nine places.
MIRRORED = """
0.134690493, 0.155831873, 0.192950964, -0.088939704, 0.0340939611, -0.114004694, -0.297910422, -0.165055797, 0.0444422811,
-0.181544244, 0.0308309793, 0.0127714518, -0.175707221, 0.022722302, -0.10354241, 0.0035235032, -0.178579107, 0.113960244,
0.0427635722, 0.271791369, -0.0441792533, -0.15214996, 0.0952210873, -0.169420019, -0.179650307, -0.0307332762, 0.159313083,
-0.243497372, -0.0842586085, -0.0616327859, 0.000540550973, -0.106009528, 0.0295329373, -0.0068105883, 0.195470765, 0.0415359661,
0.083413586, 0.121440426, 0.0328175388, -0.0405058041, -0.092358008, 0.074333325, -0.221422791, 0.0951579288, 0.151440188,
-0.0601697117, 0.00803566817, 0.11303246, -0.0633394048, -0.0938596278, 0.0316705108, 0.0303612873, 0.187394157, 0.0859285519,
-0.0126738781, 0.253517359, 0.165728718, 0.155016109, 0.13739267, -0.0829810575, 0.0221772026, -0.0324663222, -0.00374464667,
-0.0577000901
"""


def test_mirrored_maxima_are_in_the_order_of_the_sql(spark, tmp_path):
    vector = np.array([float(x) for x in MIRRORED.split(",")], np.float32)
    pq.write_table(pa.table({"vec_id": pa.array([7575]), "embedding": pa.array([vector], pa.list_(pa.float32())), "label": pa.array([1], pa.int32())}), tmp_path / "embeddings.parquet")
    con = database("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    mine = all_queries()["spc08_dominant"](spark, str(tmp_path)).toPandas()
    assert rows(mine) == rows(con.execute(all_sql()["spc08_dominant"]).df())


@pytest.mark.parametrize("size", [1, 2, 32, 64, 128])
def test_sums_in_order_equal_the_fast_transform(size):
    block = np.random.default_rng(1).normal(size=(3, size))
    assert np.allclose(spectral.transformed(block), np.fft.fft(block), atol=1e-11)


def test_spectrum_of_points_is_that_of_their_tangent_signal(spark):
    rows = [(s, "L", i, float(i * i % 7), float(i % 3), 10.0 * i) for s, n in (("a", 5), ("b", 1), ("c", 70)) for i in range(n)]
    points = spark.createDataFrame(rows, "stroke_id string, label string, i int, x double, y double, time double")
    one, other = (f.orderBy("stroke_id", "k").toPandas() for f in (spectral.tangent_spectrum(points), spectral.spectrum(spectral.tangent_signal(points))))
    assert len(one) == len(other) == 8 + 1 + 128
    assert np.allclose(one["power"], other["power"], atol=1e-9)
