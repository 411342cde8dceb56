"""Lifetimes of intermediate tables, and the folder they lie in."""

from types import SimpleNamespace

import pytest

from lumiframe.llm.linking import exclude, shared_members
from lumiframe.llm.storage import Scratch, _open, shared_dir


def test_scratch_ends_with_its_block(spark):
    with Scratch(spark, "block") as scratch:
        kept = scratch.save(spark.range(5), "a")
        assert kept.count() == 5 and scratch in _open
        scratch.drop(kept)
        again = scratch.save(spark.range(3), "a")
        assert again.count() == 3
        path = scratch.base.removeprefix("file://")
        import os

        assert os.path.isdir(path)
    assert not os.path.exists(path) and scratch not in _open


def test_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        session.sparkContext.master = master
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_dir(session)


def test_batch_size_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        Scratch(spark, "size").close()
        assert spark.conf.get(key) == "10000"
        spark.conf.unset(key)
        Scratch(spark, "size").close()
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_shared_members(spark):
    """Against a count, with a key that a third of the rows hold and repeated rows."""
    rows = [(k, n) for n in range(9000) for k in ([7] if n % 3 == 0 else [1000 + n // 4])] + [(5, 1), (5, 1), (6, 1), (6, 2), (6, 2)]
    holders = {}
    for k, n in rows:
        holders.setdefault(k, set()).add(n)
    want = {(k, n) for k, n in rows if len(holders[k]) > 1}
    with Scratch(spark, "members") as scratch:
        got = [tuple(r) for r in shared_members(spark.createDataFrame(rows, "key bigint, node bigint").repartition(5), scratch).collect()]
    assert len(got) == len(set(got)) and {(k, n) for k, n in got if len(holders[k]) > 1} == want


def test_exclude(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i) for i in range(50)] + [(None, "null", 0), (3, "again", 1)], "doc_id bigint, text string, at int")
    ids = spark.createDataFrame([(3,), (4,), (999,)], "doc_id bigint")
    got = exclude(docs, ids, "doc_id")
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == sorted(["null", *(f"t{i}" for i in range(50) if i not in (3, 4))])
