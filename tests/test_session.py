from pathlib import Path

import pytest

from scorelens import session


def test_released_copies_go(spark, tmp_path):
    outside = session.write_once(spark.range(3), "stays")
    kept = str(tmp_path / "result")
    with session.released(spark):
        inner = session.write_once(spark.range(5), "goes")
        session.settle(spark.range(5), "goes-too").write.parquet(kept)
        assert Path(inner).exists()
    assert not Path(inner).exists() and Path(outside).exists()
    assert spark.read.parquet(kept).count() == 5
    with pytest.raises(ZeroDivisionError):
        with session.released(spark):
            inner = session.write_once(spark.range(2), "goes")
            1 / 0
    assert not Path(inner).exists()
