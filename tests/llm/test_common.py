"""Scratch space: where it may be, and what stays there."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from corpusloom.llm import common


def test_intermediate_tables_go_with_their_scope(spark):
    outer = common.materialize(spark.range(3), "outer")
    with common.intermediates(spark):
        inner = common.materialize(spark.range(4), "inner")
        assert inner.count() == 4
    place = lambda df: df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(place(outer)) and outer.count() == 3
    assert not os.path.exists(place(inner))


def test_scope_ends_on_errors(spark):
    with pytest.raises(RuntimeError), common.intermediates(spark):
        kept = common.materialize(spark.range(2), "failed").inputFiles()[0].removeprefix("file://")
        raise RuntimeError
    assert not os.path.exists(kept)


def test_a_cluster_must_name_its_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
