"""The library's own operators against SQL on the smallest tables, and against values worked out by hand."""

import math

import duckdb
import pytest

from edgetide.functions import stats
from edgetide.operators import extended
from edgetide.plans import catalog
from edgetide.sources import blif, sdf, vcd
from edgetide.streaming import waveform as streamed

SF = "/root/testdata/sf0.001"
CHEAP = list(catalog.ORACLES)


def plain(frame, columns):
    def text(x):
        if str(x) in ("<NA>", "None", "nan"):
            return ""
        return str(float(x)) if not isinstance(x, str) else x

    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


def test_critical_path():
    assert blif.circuit(catalog.ADDER1).critical_path() == 40


def test_quantiles():
    assert abs(stats.t_quantile(0.975, 10) - 2.228139) < 1e-5
    low, high = stats.clopper_pearson(5, 20, 0.95)
    assert abs(low - 0.086571) < 1e-5 and abs(high - 0.491046) < 1e-5


def test_cap_needs_a_bin():
    with pytest.raises(ValueError):
        extended.cap_bin([{1: 1}], 10, 0)
    assert extended.cap_bin([{i: 1 for i in range(100)}, {0: 1, 5: 1}], 20, 10) == [10, 2]


def test_sdf_round_trip_of_names():
    assert sdf.unescape(sdf.escape("a.b[3]")) == "a.b[3]"
    assert sdf.parse(catalog.SDF)["cells"][1]["iopaths"][1]["rise"]["max"] == 20


def test_blif_reader(spark, tmp_path):
    (tmp_path / "x.blif").write_text(catalog.ADDER1)
    read = blif.read(spark, str(tmp_path))
    assert read["names"].count() == 2 and read["ports"].where("dir = 'in'").count() == 3
    nets = blif.nets(read["ports"], read["names"], read["latches"])
    assert blif.clean(nets).count() == 5


def test_vcd_reader(spark, tmp_path):
    (tmp_path / "x.vcd").write_text("$var wire 1 ! clk $end\n$enddefinitions $end\n#0\n0!\n#5\n1!\n#9\nx!\n")
    signals, changes = vcd.read(spark, str(tmp_path / "x.vcd"))
    assert signals.first()["name"] == "clk"
    assert [(r.t, r.val) for r in changes.orderBy("seq").collect()] == [(0, "0"), (5, "1"), (9, "x")]


def test_stream_equals_batch(spark, tmp_path):
    from edgetide.operators import waveform
    from edgetide.plans import inputs

    rows = inputs.changes(spark, SF).where("run_id < 3").select("run_id", "signal", "t", "val")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streamed.cycles(stream, "view", ["purchase", "error"]).writeStream.format("memory").queryName("cycles_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    columns = ["run_id", "cycle", "signal", "delay"]
    batch = waveform.measured(rows, "view", ["purchase", "error"]).toPandas()
    assert plain(spark.table("cycles_out").toPandas(), columns) == plain(batch, columns)


def test_permutation_cap_goes_on_to_its_limit():
    assert math.prod(extended.cap_bin([{i: 1 for i in range(5000)}] * 6, 1000, 1)) == 972
