import struct

import pytest

from scalarscape.sources import landing, tdv
from scalarscape.streaming import incremental

VARIABLES = ["X", "Y", "Z", "rho", "flag"]
ZONES = [
    dict(name="sphere", zone_type="FETRIANGLE", size=(4, 2), arrays={"X": [0, 1, 2, 3], "Y": [0, 0, 1, 1], "Z": [1, 2, 3, 4], "rho": [0.5, 0.25, 0.125, 1], "flag": [1, 2, 3, 4]}, cells=[[0, 1, 2], [1, 2, 3]], aux={"ZoneType": "AtomSphereData"}, formats=[2, 1, 3, 1, 5]),
    dict(name="again", zone_type="FETRIANGLE", size=(4, 2), arrays={"X": 0, "Y": 0, "Z": 0, "rho": [9, 8, 7, 6], "flag": None}, cells_of=0),
    dict(name="path", zone_type="ORDERED", size=(3, 1, 1), arrays={"X": [1, 2, 3], "Y": [1, 2, 3], "Z": [1, 2, 357], "rho": [1, 2, 3], "flag": [7, 8, 9]}, formats=[2, 2, 1, 4, 5]),
]


def read(spark, table, path):
    tdv.register(spark)
    return spark.read.format("tdv").option("table", table).load(str(path))


@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(spark, tmp_path, order):
    trap = struct.unpack("i", struct.pack("f", 357.0))[0]  # the marker's bytes in the header
    tdv.write_file(str(tmp_path / "a.plt"), "tïtle", VARIABLES, [ZONES[0] | {"color": trap}, *ZONES[1:]], {"k": "v"}, {3: {"VariableType": "DGBCondensedField"}, 99: {"x": "y"}}, order)
    head = read(spark, "datasets", tmp_path).first()
    assert head.title == "tïtle" and head.n_vars == 5 and head.aux == {"k": "v"}
    assert {r.name: r.aux for r in read(spark, "variables", tmp_path).collect()}["rho"] == {"VariableType": "DGBCondensedField"}
    assert [(r.zone_id, r.zone_type, r.imax, r.jmax, r.aux) for r in read(spark, "zones", tmp_path).orderBy("zone_id").collect()][0] == (0, "FETRIANGLE", 4, 2, {"ZoneType": "AtomSphereData"})
    fields = read(spark, "fields", tmp_path)
    assert [r.value for r in fields.where("zone_id = 1 and field = 'rho'").orderBy("vertex_id").collect()] == [9, 8, 7, 6]
    assert fields.where("zone_id = 1 and field = 'flag'").count() == 0  # passive
    assert read(spark, "points", tmp_path).where("zone_id = 1").count() == 4  # shared
    assert [r.nodes for r in read(spark, "cells", tmp_path).where("zone_id = 1").orderBy("cell_id").collect()] == [[0, 1, 2], [1, 2, 3]]


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad.plt").write_bytes(b"no such format at all")
    with pytest.raises(Exception, match="not a file of this format"):
        read(spark, "zones", tmp_path).collect()
    whole = tmp_path / "cut" / "c.plt"
    whole.parent.mkdir()
    tdv.write_file(str(whole), "t", VARIABLES, ZONES)
    whole.write_bytes(whole.read_bytes()[:-10])
    with pytest.raises(Exception, match="ends early"):
        read(spark, "fields", whole.parent).collect()


def test_landing_and_staleness(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tdv.write_file(str(tmp_path / "in" / "a.plt"), "t", VARIABLES, ZONES)
    landing.land(spark, str(tmp_path / "in"), str(tmp_path / "out"), ("zones", "fields"))
    assert spark.read.parquet(str(tmp_path / "out" / "zones")).count() == 3
    files = landing.listing(spark, str(tmp_path / "in"))
    assert files.first().extension == "plt"
    done = files.selectExpr("name", "modified as landed_at")
    assert landing.stale(files, done).count() == 0 and landing.stale(files, done.limit(0)).count() == 1


def test_stream_lands_each_file_once(spark, tmp_path):
    rows = [(i, "a", i, '{"origin": "/x/%d.plt"}' % i) for i in range(5)]
    schema = "file_id long, series string, file_seq int, body string"
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    for part in (rows[:3], rows[2:]):  # the third file is sent twice
        df = spark.createDataFrame(part, schema).selectExpr("file_id", "series", "file_seq", "timestamp_ntz'2025-01-01' as written_at", "timestamp_ntz'2025-01-01' as received_at", "body")
        df.write.mode("append").parquet(source)
        incremental.land_stream(spark, source, target, str(tmp_path / "checkpoint")).awaitTermination()
    got = incremental.landed(spark, target)
    assert sorted((r.file_id, r.plt_path) for r in got.collect()) == [(i, f"/x/{i}.plt") for i in range(5)]
