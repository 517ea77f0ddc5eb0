import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from termloom import session
from termloom.operators.search import _block_top_k, _Entities


def test_pinned_tables_live_in_the_shared_folder(spark):
    root = session.shared_dir(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    before = len(session._made())
    df = session.pinned(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert all(f"{root}/termloom-pinned-" in f for f in df.inputFiles())
    with session.work_scope(spark):
        inner = session.pinned(spark.range(3))
        assert inner.count() == 3
    assert df.count() == 10
    assert session.remove_work(spark, keep=before) == 1
    assert session.remove_work(spark, keep=before) == 0


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    """Loaded and run by a process that cannot import the package."""
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((_block_top_k, _Entities)))
    code = (
        "import pickle, pyarrow as pa, importlib.util as u\n"
        "assert u.find_spec('termloom') is None\n"
        "f, e = pickle.load(open('f.pkl', 'rb'))\n"
        "t = lambda n: pa.table({n: ['a', 'b'], 'vec': [[1.0, 0.0], [0.0, 1.0]]})\n"
        "print(f(t('query_id'), e(t('entity_id')), 1).column('entity_id').to_pylist())\n"
    )
    run = subprocess.run(
        [sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert run.stdout.strip() == "['a', 'b']", run.stderr
