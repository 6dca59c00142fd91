import pytest

from docflow import configure
from docflow.session import SETTINGS, durable, is_done, once, run_dir, shared_dir, stored


def test_settings_and_shuffle_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, input_bytes=100 * 1024**4)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 819200
        assert all(spark.conf.get(k) == v for k, v in SETTINGS.items())
        configure(spark, input_bytes=1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 819200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_files_go_below_the_shared_folder(spark):
    first, second = run_dir(spark, "x"), run_dir(spark, "x")
    assert first != second
    assert first.startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = durable(spark.range(3))
    assert df.count() == 3
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + shared_dir(spark))


def test_steps_run_once(spark, tmp_path):
    runs = []
    path = str(tmp_path / "step")
    assert not is_done(spark, path)
    for _ in range(2):
        once(spark, path, lambda: runs.append(1))

    def build():
        runs.append(2)
        return spark.range(0).withColumnRenamed("id", "empty")

    for _ in range(2):
        df = stored(spark, str(tmp_path / "table"), build)
        assert df.columns == ["empty"]
        assert df.count() == 0
    assert runs == [1, 2]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
