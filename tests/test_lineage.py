"""Broadcasts behind measured sizes, and where lineage is cut."""

import pytest

from feldspar.plans import lineage


def hinted(df):
    return "hint" in df._jdf.queryExecution().logical().toString().lower()


def test_sizes_are_measured(spark):
    short = spark.createDataFrame([(1, "a", ["x"], [1.0], {"k": 1})] * 10, "id long, s string, a array<string>, d array<double>, m map<string, int>")
    long = spark.createDataFrame([(1, "a" * 10_000, ["x" * 5_000], [1.0] * 1_000, {"k" * 1_000: 1})] * 10, short.schema)
    small, large = lineage.size_bytes(short), lineage.size_bytes(long)
    assert 10 * 50 < small < 10 * 300 and large > 10 * 24_000
    assert lineage.size_bytes(spark.createDataFrame([(None, None, None, None, None)], short.schema)) < 300
    assert lineage.size_bytes(short.where("false")) == 0
    assert hinted(lineage.broadcast_if_small(short, limit=3_000)) and not hinted(lineage.broadcast_if_small(long, limit=3_000))
    assert hinted(lineage.broadcast_if_small(short, 8, 80)) and not hinted(lineage.broadcast_if_small(short, 8, 79))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Sc:
                        @staticmethod
                        def getCheckpointDir():
                            class Empty:
                                @staticmethod
                                def isEmpty():
                                    return True

                            return Empty

                    return Sc

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Cluster)
    lineage.ensure_checkpoint_dir(spark)
    assert lineage.cut(spark.range(3)).count() == 3
