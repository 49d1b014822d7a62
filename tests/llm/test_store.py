import os
import subprocess
import sys

import pytest

PROGRAM = """
from tidemark.session import local_session
from tidemark.llm import sharding, store
spark = local_session(2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
found = store.shared_dir(spark)
assert found == store.shared_dir(spark) and found.startswith("file:")
docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
assert sharding.sharded(docs).count() == 20
path = store.new_path(spark, "x")
assert store.written(docs, "x", path).count() == 20
store.removed(spark, path)
print("fine")
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    """In a process that reads no defaults, as a plain installation has none."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TIDEMARK_DRIVER_MEMORY": "1g"}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_a_cluster_without_one_is_an_error():
    from types import SimpleNamespace

    from tidemark.llm import store

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(session)
