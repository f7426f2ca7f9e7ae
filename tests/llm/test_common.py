from __future__ import annotations

import pytest

from platterlens.llm.common import drop_written, written


def test_only_written_tables_are_dropped(spark, tmp_path):
    df = written(spark.range(3), "test")
    assert df.count() == 3
    drop_written(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        df.count()
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    own = spark.read.parquet(str(tmp_path / "mine"))
    for other in (own, df.filter("id > 0")):
        with pytest.raises(ValueError, match="only a table"):
            drop_written(other)
    assert own.count() == 3
