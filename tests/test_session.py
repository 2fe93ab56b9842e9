import types

import pytest

from leafledger import session


def test_a_cluster_must_name_the_shared_folder():
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    spark = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)
