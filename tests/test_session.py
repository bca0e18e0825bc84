"""Tables of intermediate results, and the folder they go to."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from tessera.session import cut, release, scratch, shared_folder


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_the_folder_named_by_the_cluster_is_taken():
    assert shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs:///work/"))) == "hdfs:///work"


def test_tables_are_dropped_when_released_and_at_the_end_of_a_block(spark):
    with scratch(spark):
        a, b = cut(spark.range(5), "a"), cut(spark.range(7), "b")
        paths = [Path(x._tessera_path.removeprefix("file:")) for x in (a, b)]
        assert a.count() == 5 and all(p.exists() for p in paths)
        release(a)
        assert not paths[0].exists() and paths[1].exists() and b.count() == 7
    assert not paths[1].exists()
