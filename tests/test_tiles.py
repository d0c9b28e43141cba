"""Every field of a wave tile: lengths and scales."""

import pytest
from pyspark.sql import functions as F

from pelagos.sources import tiles


def test_all_fields(spark):
    sizes = {k: 24 if size is None else size + each * 2 for k, (_, size, each) in tiles.FIELDS.items()}
    wire = spark.range(1).select(F.array(F.lit(1.0)).alias("lat"), F.array(F.lit(2.0)).alias("lon"), *(F.array(F.array_repeat(F.lit(7), n)).alias(k) for k, n in sizes.items()))
    cells = tiles.checked(tiles.cells_of(wire), 2)
    for field, (scale, _, _) in tiles.FIELDS.items():
        values = tiles.monthly(cells, field, width=max(1, sizes[field] // 12)).collect()
        assert len(values) == sizes[field] and {v.value for v in values} == {7 / scale}, field
    with pytest.raises(Exception, match="does not fit its manifest"):
        tiles.checked(tiles.cells_of(wire), 3).collect()
