"""Streams over driver tables that are folders of files, as large ones are."""

from __future__ import annotations

import os

import pytest

from patchwell.plans.queries import QUERIES
from tests.tables import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("folders"))
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
        assert os.path.isdir(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize("name", ["streamed_findings", "streamed_history", "streamed_rule_hits", "running_summary"])
def test_a_folder_streams_as_one_file_does(spark, folders, name):
    want = QUERIES[name](spark, SF)
    assert rows(QUERIES[name](spark, folders), *want.columns) == rows(want, *want.columns) != []
