"""Defective files, archives, sinks, snapshots."""

import csv
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from holdfast.functions.numbers import number
from holdfast.sources import archive, sinks, tables
from holdfast.streaming import snapshots


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_fields_survive_a_round_trip(spark, tmp_path):
    """Whatever the csv module quotes comes back: separators, quotes, line breaks, blanks at either end."""
    rng = random.Random(12)
    bits = ["mast", " ", ",", '"', "\n", "é", ";", "0"]
    data = [[str(k), *("x" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) + "y" for _ in range(2))] for k in range(120)]
    with open(tmp_path / "r.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\r\n", quoting=csv.QUOTE_ALL).writerows([["K", "P", "Q"], *data])
    df = tables.read_table(spark, str(tmp_path / "r.csv"), ["K", "P", "Q"])
    assert sorted(rows(df, "K", "P", "Q")) == sorted(map(tuple, data))
    assert rows(tables.defects(df), "rows", "ragged") == [(120, 0)]


def test_blank_lines_and_no_last_newline(spark, tmp_path):
    df = tables.read_table(spark, write(tmp_path / "b.csv", "K,P\n\nm,\n\n\nn,o"), ["K", "P"])
    assert sorted(rows(df, "K", "P")) == [("m", None), ("n", "o")]


def test_rows_of_another_length_are_kept_and_counted(spark, tmp_path):
    df = tables.read_table(spark, write(tmp_path / "a.csv", "K,P,Q,R\nfull,b,c,d\nlone\nlong,b,c,d,e,f\n"), ["K", "P", "Q", "R"])
    assert sorted(rows(df, "K", "Q", "_ragged"), key=str) == [("full", "c", False), ("lone", None, True), ("long", "c", True)]
    assert rows(tables.defects(df), "rows", "ragged") == [(3, 2)]
    assert rows(df.groupBy().count(), "count") == [(3,)]


def test_every_file_must_have_the_declared_header(spark, tmp_path):
    one = write(tmp_path / "one.csv", "\ufeffMAST,OWNER\nt1,o1\n")
    two = write(tmp_path / "two.csv", "OWNER,MAST\no2,t2\n")
    three = write(tmp_path / "three.csv", "MAST,OWNER\nt3,o3\n")
    assert sorted(rows(tables.read_table(spark, [one, three], ["MAST", "OWNER"]), "MAST")) == [("t1",), ("t3",)]
    with pytest.raises(tables.HeaderMismatch):
        tables.read_table(spark, two, ["MAST", "OWNER"])
    both = tables.read_table(spark, [one, two], ["MAST", "OWNER"])
    for narrow in (both, both.select("MAST"), both.groupBy().count()):
        with pytest.raises(Exception, match="(?s)header|FAILED_READ_FILE"):
            narrow.collect()


def test_a_quoted_field_longer_than_a_read_block(spark, tmp_path):
    pad = "z" * ((1 << 20) - 6)
    df = tables.read_table(spark, write(tmp_path / "a.csv", f'A,B\n1,"{pad}""q"\n'), ["A", "B"])
    assert df.count() == 1 and df.first()["B"] == pad + '"q'


def test_types_and_parquet(spark, tmp_path):
    df = tables.read_table(spark, write(tmp_path / "a.csv", "F,D,S\n1.5e9,2020-02-30,x\n,2021-03-04,\nNaN,,y\n"), ["F", "D", "S"])
    out = tables.to_parquet(tables.typed(df, {"F": "double", "D": "date"}), str(tmp_path / "p"), files=3)
    assert sorted(((r["F"], str(r["D"]), r["S"]) for r in out.collect()), key=str) == \
        sorted([(1.5e9, "None", "x"), (None, "2021-03-04", None), (None, "None", "y")], key=str)
    assert dict(out.dtypes)["D"] == "date"


def test_lookups_and_latest_value(spark, tmp_path):
    look = tables.lookup_table(spark, write(tmp_path / "l.csv", "SV_ID,SV_NAME\n1,Fixed\n2,Land\n"), ["SV_ID", "SV_NAME"], "SV_ID", "SV_NAME")
    assert sorted(rows(look, "code", "text")) == [("1", "Fixed"), ("2", "Land")]
    path = write(tmp_path / "p.csv", "CODE,TIME,VALUE\n101,2023,5\n101,2024,7\n102,2024,x\n")
    assert sorted(rows(tables.latest_value(spark, path, ["CODE", "TIME", "VALUE"], "CODE", "VALUE", "TIME"), "code", "value"), key=str) == \
        [("101", 7.0), ("102", None)]


@pytest.fixture
def archives(tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    for month, body in (("2026-07", 'A,B\n1,"x,y"\n2\n'), ("2026-08", "﻿A,B\r\n3,\r\n\r\n4,5")):
        with zipfile.ZipFile(folder / f"{month}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("rrl/licence.csv", body)
            if month == "2026-08":
                z.writestr("site.csv", "S\n1\n")
    return str(folder)


def test_archives(spark, archives):
    found = archive.members(spark, archives)
    assert found.count() == 3 and found.filter("member = 'licence.csv'").count() == 2
    records = archive.records(spark, archives, "licence.csv", ["A", "B"])
    month = F.regexp_extract("archive", r"(\d{4}-\d{2})", 1)
    assert sorted(rows(records, month, "A", "B", "_ragged"), key=str) == [
        ("2026-07", "1", "x,y", False), ("2026-07", "2", None, True), ("2026-08", "3", None, False), ("2026-08", "4", "5", False)]


def test_members_of_one_archive_go_to_their_own_tasks(spark, tmp_path, monkeypatch):
    """Members of several blocks, packed and plain, equal the same files read as tables."""
    monkeypatch.setattr(archive, "BLOCK", 1000)
    rng, bodies = random.Random(3), {}
    (tmp_path / "plain").mkdir()
    with zipfile.ZipFile(tmp_path / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for nth in range(4):
            rows_ = "".join(f'{nth}-{k},"{"é" * rng.randint(0, 9)}\n,""{rng.random()}"\r\n' for k in range(400 + nth))
            bodies[nth] = "K,P\r\n" + rows_ + ("" if nth else "long," + "z" * 5000)
            z.writestr(f"d{nth}/t.csv", bodies[nth], zipfile.ZIP_STORED if nth == 2 else zipfile.ZIP_DEFLATED)
            (tmp_path / "plain" / f"{nth}.csv").write_bytes(bodies[nth].encode())
    folder = archive.unpacked(spark, str(tmp_path / "all.zip"), "t.csv")
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("f")).collect()
    assert len({r["f"].rsplit("/", 1)[-1].split("-")[1] for r in files}) == len(files) == 4
    got = archive.records(spark, str(tmp_path / "all.zip"), "t.csv", ["K", "P"])
    want = tables.read_table(spark, str(tmp_path / "plain"), ["K", "P"])
    assert sorted(rows(got, "K", "P", "_ragged"), key=str) == sorted(rows(want, "K", "P", "_ragged"), key=str)
    assert archive.records(spark, str(tmp_path / "all.zip"), "none.csv", ["K", "P"]).count() == 0


def test_a_damaged_member_stops_the_job(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("t.csv", "K\nabcdef\n")
    raw = (tmp_path / "d.zip").read_bytes()
    (tmp_path / "d.zip").write_bytes(raw.replace(b"abcdef", b"abcdeg"))
    with pytest.raises(Exception, match="ManifestError"):
        archive.records(spark, str(tmp_path / "d.zip"), "t.csv", ["K"])


def test_manifest(spark, archives):
    found = archive.members(spark, archives)
    assert [r["member"] for r in archive.missing_members(found, ["licence.csv", "site.csv"]).collect()] == ["site.csv"]
    archive.require_members(found, ["licence.csv"])
    with pytest.raises(archive.ManifestError):
        archive.require_members(found, ["licence.csv", "site.csv"])
    with pytest.raises(archive.ManifestError):
        archive.require_rows(spark.range(3), 4, "boundaries")
    archive.require_rows(spark.range(4), 4, "boundaries")


def test_a_member_with_another_header_stops_the_job(spark, archives):
    with pytest.raises(Exception, match="ManifestError"):
        archive.records(spark, archives, "licence.csv", ["A", "C"]).count()


def test_results_are_written_stamped_and_read_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    sinks.write_results({"a": spark.range(3), "b": spark.range(2).withColumnRenamed("id", "k")}, folder, "Based on X", ("parquet", "json"))
    results = sinks.Results(spark, folder)
    a = results.load("a")
    assert a is results.load("a") and a.count() == 3
    assert a.schema["id"].metadata["provenance"] == "Based on X"
    assert sorted(rows(results.load("_provenance"), "result")) == [("a",), ("b",)]
    assert spark.read.json(f"{folder}/json/b").count() == 2
    with pytest.raises(Exception):
        results.load("missing")
    results.release()


def test_names_lie_apart_from_the_points(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "here")], "id int, lat double, name string")
    sinks.write_point_layer(df, str(tmp_path / "layer"), "id", "name")
    assert spark.read.parquet(str(tmp_path / "layer/points")).columns == ["id", "lat"]
    assert rows(spark.read.parquet(str(tmp_path / "layer/point_names")), "id", "name") == [(1, "here")]
    nested = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int").agg(sinks.as_object(F.col("k"), F.col("v")).alias("m"))
    assert nested.first()["m"] == {"a": 1, "b": 2}


def test_snapshots_are_taken_in_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))

    def rollup(batch):
        return batch.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.sum(number(F.col("v"))).alias("v"))

    def arrive(values):
        spark.createDataFrame(values, "k string, v string").coalesce(1).write.mode("append").parquet(source)
        snapshots.take_in(spark, source, "k string, v string", target, progress, rollup)
        return sorted(rows(snapshots.added_up(spark, target, ["k"], ["rows", "v"]), "k", "rows", "v"))

    assert arrive([("a", "1"), ("b", "2"), ("a", "x")]) == [("a", 2, 1.0), ("b", 1, 2.0)]
    assert arrive([("a", "5")]) == [("a", 3, 6.0), ("b", 1, 2.0)]
    snapshots.take_in(spark, source, "k string, v string", target, progress, rollup)
    assert sorted(rows(snapshots.added_up(spark, target, ["k"], ["rows"]), "k", "rows")) == [("a", 3), ("b", 1)]


def total(staged, want):
    from holdfast.operators import checks as Q
    return Q.run_checks({"a": staged["a"]}, [Q.equals("total", "a", F.sum("v"), want)])


def test_a_failed_publication_changes_nothing(spark, tmp_path):
    from holdfast.operators.checks import GateFailure
    folder = str(tmp_path)
    assert sinks.Published(spark, folder).version is None and sinks.Published(spark, folder).manifest().count() == 0
    with pytest.raises(KeyError):
        sinks.Published(spark, folder).load("a")
    first = {"a": spark.createDataFrame([(1,), (2,)], "v int"), "b": spark.range(5)}
    assert sinks.publish(spark, first, folder, "Based on x", lambda s: total(s, 3)) == 1
    kept = sinks.Published(spark, folder)
    with pytest.raises(GateFailure):
        sinks.publish(spark, {"a": spark.createDataFrame([(9,)], "v int")}, folder, "Based on y", lambda s: total(s, 3))

    def interrupted(staged):
        raise RuntimeError("the driver is gone")
    with pytest.raises(RuntimeError):
        sinks.publish(spark, first, folder, "Based on y", interrupted)
    again = sinks.Published(spark, folder)
    assert (again.version, again.run) == (1, kept.run)
    assert sorted(rows(again.manifest(), "result", "rows", "provenance")) == [("a", 2, "Based on x"), ("b", 5, "Based on x")]
    assert again.load("a").schema["v"].metadata == {"provenance": "Based on x"}


def test_versions_are_swapped_whole_and_stay_readable(spark, tmp_path):
    folder = str(tmp_path)
    one, two = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2,), (3,)], "v int")
    sinks.publish(spark, {"a": one, "old": one}, folder, "x")
    before = sinks.Published(spark, folder)
    assert sinks.publish(spark, {"a": two}, folder, "x") == 2
    assert rows(before.load("a"), "v") == [(1,)]
    assert sorted(rows(sinks.Published(spark, folder).load("a"), "v")) == [(2,), (3,)]
    assert rows(sinks.Published(spark, folder).manifest(), "result", "rows") == [("a", 2)]
    assert rows(sinks.Published(spark, folder, 1).load("old"), "v") == [(1,)]
    with pytest.raises(KeyError):
        sinks.Published(spark, folder, 7)
    with pytest.raises(ValueError):
        sinks.publish(spark, {}, folder, "x")
