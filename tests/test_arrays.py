"""Arrays read by row ranges."""

import numpy as np
import pytest

from tessera.sources.arrays import array_rows


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    wide, line = rng.normal(size=(20_000, 3)).astype(np.float32), np.arange(700)
    np.save(tmp_path / "a.npy", wide)
    np.save(tmp_path / "b.npy", line)
    np.save(tmp_path / "c.npy", np.zeros((0, 2)))
    got = array_rows(spark, str(tmp_path / "a.npy"), rows=3000)
    assert got.rdd.getNumPartitions() == 7
    rows = sorted((r.row, r["values"]) for r in got.collect())
    assert [i for i, _ in rows] == list(range(20_000)) and np.array_equal(np.array([v for _, v in rows]), wide.astype(float))
    both = array_rows(spark, f"file://{tmp_path}", rows=500)
    assert both.where("file like '%b.npy'").count() == 700 and both.count() == 20_700
    assert array_rows(spark, str(tmp_path / "c.npy")).count() == 0


def test_other_arrays_are_errors(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.array(["x"]))
    with pytest.raises(Exception, match="rows of numbers"):
        array_rows(spark, str(tmp_path / "t.npy")).collect()
    with pytest.raises(Exception, match="none.npy"):
        array_rows(spark, str(tmp_path / "none.npy")).collect()
