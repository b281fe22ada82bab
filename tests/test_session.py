from types import SimpleNamespace

import pytest

from corpusmill import session


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


def _stub(master, **conf):
    context = SimpleNamespace(master=master, getConf=lambda: _Conf(), applicationId="app-1")
    return SimpleNamespace(conf=_Conf(conf), sparkContext=context)


def test_scratch_stands_in_the_named_folder():
    stub = _stub("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert session.scratch_path(stub, "words").startswith("hdfs:///shared/corpusmill/app-1/words-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        session.scratch_root(_stub("spark://host:7077"))


def test_a_local_session_gets_its_own_folder():
    stub = _stub("local[2]")
    assert session.scratch_root(stub) == session.scratch_root(stub)


def test_written_table_knows_its_size_and_is_cleared(spark):
    table = session.write_table(spark.range(10), "ten")
    assert table.df.count() == 10 and table.size > 0


def test_tables_on_the_way_are_removed(spark):
    inner = []

    def make():
        inner.append(session.write_scratch(spark.range(10), "on-the-way"))
        return spark.read.parquet(inner[0]).where("id < 4")

    table = session.materialize_alone(spark, make, "result")
    assert table.count() == 4 and "on-the-way" not in " ".join(table.inputFiles())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner[0])
    with pytest.raises(ZeroDivisionError):
        session.materialize_alone(spark, lambda: 1 / 0)
    assert "passing" not in session.scratch_path(spark, "next")
