"""A batch that was logged under a larger per_trigger is read whole after a restart."""

import pytest
from pyspark.errors import StreamingQueryException

from rangeweave.streaming import ingest


def test_restart_with_a_smaller_bound(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.csv").write_text(f"k,v\n{i},0\n")

    def fails(d, n):
        raise ValueError("stopped before the commit")

    start = lambda sink, n: ingest.ingest(spark, "csv", str(folder), sink, f"{tmp_path}/check", glob="*.csv", per_trigger=n, num_chunks=1)
    with pytest.raises(StreamingQueryException):
        start(fails, 4).awaitTermination()
    seen = []
    start(lambda d, n: seen.extend(x.k for x in d.collect()), 1).awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3]
