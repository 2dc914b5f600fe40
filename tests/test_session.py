from types import SimpleNamespace

import pytest

from rill.session import shared_folder


def fake(root, master="local[2]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: root), sparkContext=SimpleNamespace(applicationId="app", master=master))


def test_the_clusters_folder_is_used_where_it_is_named():
    assert shared_folder(fake("file:///shared/")).startswith("file:///shared/rill-")


def test_own_folder_is_made_once():
    a, b = shared_folder(fake("")), shared_folder(fake(""))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake("", "spark://host:7077"))
