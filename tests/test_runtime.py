from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skein import runtime
from skein.operators.content import decode_text


def test_staged_data_goes_at_the_end_of_its_block(spark):
    with runtime.staging(spark):
        held = runtime.stage(spark.range(5), "x")
        folder = held.inputFiles()[0].rsplit("/", 1)[0]
        assert held.count() == 5 and runtime.input_bytes(spark, folder) > 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        runtime.input_bytes(spark, folder)


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda key: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda f: None)
    with pytest.raises(RuntimeError):
        runtime.shared_dir(SimpleNamespace(sparkContext=context))
    context.master = "local[4]"
    assert runtime.shared_dir(SimpleNamespace(sparkContext=context))


def test_charsets(spark):
    rows = [("ä€".encode(), None, "ä€"), ("ä€".encode("cp1252"), "Windows-1252", "ä€"), ("я".encode("koi8-r"), "koi8-r", "я"), (b"\xe4", "utf-8", "ä"), (b"\xe4", "nonsense", "ä"), ("漢".encode("utf-16"), "utf-16", "漢"), (None, "koi8-r", None)]
    got = spark.createDataFrame([r[:2] for r in rows], "b binary, c string").select(decode_text(F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
