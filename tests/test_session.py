import pytest

from netloom import session


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Spark:
    def __init__(self, **conf):
        self.conf = _Conf(conf)


def test_missing_shared_folder_is_an_error_off_local_mode():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(_Spark(**{"spark.master": master}))
    assert session.shared_dir(_Spark(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


def test_only_run_folders_are_removed(spark):
    path = session.run_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    session.drop_run(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        session.drop_run(spark, "/root")


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A session of its own, started elsewhere, whose workers have no path to the package but what was shipped."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"import sys\nsys.path.insert(0, {root!r})\n"
        "from pyspark.sql import functions as F\nfrom netloom.functions import times\nfrom netloom.session import build_session, ship\n"
        "spark = build_session('elsewhere', 'local[1]', **{'spark.ui.enabled': 'false'})\nship(spark)\n"
        "print('FOUND', spark.range(3).select(F.udf(times.to_micros, 'long')('id')).collect()[2][0])\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 2000000" in out.stdout, out.stderr[-2000:]
