"""Queries on the theme closure as the first one of a session in a process of its own."""

import subprocess
import sys

import pytest
from conftest import REPO, SMALL

RUN = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {repo!r})
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
from textloom import operators, registry
print("rows", registry.QUERIES[{name!r}](spark, {sf!r}).count())
"""


@pytest.mark.parametrize("name", ("d4_reviewed_negatives", "d4_reviewed_negatives_strict", "f7_queue_page", "d20_label_sources", "g7_evaluate_run"))
def test_first_query(name, tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, folder=str(tmp_path), name=name, sf=SMALL)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split("rows")[1]) >= 0, done.stderr[-2_000:]
