import json
from datetime import UTC, date as D, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import regime
from tidegauge.sources import readers, store, workbooks
from tidegauge.streaming import revisions


def test_chart_csv(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("time,open,close\n2024-01-03,1,12\n2024-01-02,1,x\n2024-01-01,1,10\n2024-01-03,1,13\nbad,1,2\n")
    (tmp_path / "XYZ.csv").write_text("time,open,close\n2024-01-01,1,5\n")
    registry = spark.createDataFrame([("ABC", "INDEX", 0.1)], "file_id string, id string, scale double")
    got = sorted(tuple(r) for r in readers.chart_csv(spark, str(tmp_path / "*.csv"), registry).collect())
    assert got == [("INDEX", D(2024, 1, 1), 1.0), ("INDEX", D(2024, 1, 3), pytest.approx(1.3))]
    assert readers.chart_csv(spark, str(tmp_path / "*.csv")).count() == 3


def test_json_and_wide(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"indicator_id": "P", "frequency": "M", "data": {"2024-01-01": 1.5, "2024-02-01": None}}))
    assert readers.series_json(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "p.json").write_text(json.dumps([{"d": "2024-01-02T00:00:00.000", "l": "10", "s": "4"}, {"d": "2024-01-09", "l": "x", "s": "4"}]))
    got = {str(r.obs_date): r.spec_net for r in readers.positions_json(spark, str(tmp_path / "p.json"), "d", [("spec", "l", "s")]).collect()}
    assert got == {"2024-01-02": 6.0, "2024-01-09": None}
    (tmp_path / "w.json").write_text(json.dumps([{"d": "2024-01-02", "l": "90", "s": "4"}, {"d": "2024-01-02", "l": "10", "s": "3"}]))
    assert readers.positions_json(spark, str(tmp_path / "w.json"), "d", [("spec", "l", "s")]).first().spec_net == 7.0
    wide = spark.createDataFrame([("USD", "60.5", "n/a", "z")], "c string, `2003-Q1` string, `2003-Q2` string, note string")
    assert [tuple(r) for r in readers.wide_quarters(wide, ["c"]).collect()] == [("USD", D(2003, 1, 1), 60.5)]


def test_positional_and_labels(spark, tmp_path):
    (tmp_path / "g.csv").write_text("title\nnotes\nDate,B0,B1,T2\n2024-01-02,4.0,-0.5,-999.99\n2024-01-03,.,1,2\n")
    rows = readers.positional(spark, str(tmp_path / "g.csv"), {0: "date", 1: "b0", 3: "t2"}, skip=3)
    assert sorted(tuple(r) for r in rows.collect()) == [("2024-01-02", "4.0", None), ("2024-01-03", None, "2")]
    long = readers.long_series(rows, readers.either_date(F.col("date"), ["yyyy/MM/dd", "yyyy-MM-dd"]), {"b0": "B"}, scale=100, month_end=True)
    assert [tuple(r) for r in long.collect()] == [(*("B", D(2024, 1, 31)), 400.0)]
    labels = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 2, 1), None), ("b", D(2024, 1, 1), None)], "id string, obs_date date, value double")
    assert readers.known_labels(labels).count() == 1


def test_turning_points_csv(spark, tmp_path):
    head = "peak_date,peak_announcement_date,trough_date,trough_announcement_date,source_url,notes\n"
    (tmp_path / "c.csv").write_text(head + "1980-01,1980-06-03,1980-07,1981-07-08,u,n\n")
    assert readers.turning_points(spark, str(tmp_path / "c.csv")).count() == 2
    (tmp_path / "bad.csv").write_text(head + "1980-01,1979-06-03,1980-07,1981-07-08,u,n\n")
    with pytest.raises(Exception, match="too early"):
        readers.turning_points(spark, str(tmp_path / "bad.csv")).collect()


def test_store_detects_damage(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(store.StoreError):
        store.read_table(spark, path)
    manifest = store.write_table(spark.range(50), path, "v1", unit="pct")
    assert manifest["row_count"] == 50 and store.read_table(spark, path, "v1", 10).count() == 50
    for bad in ({"schema_version": "v2"}, {"least_rows": 99}):
        with pytest.raises(store.StoreError):
            store.read_table(spark, path, **bad)
    now = datetime.now(UTC)
    assert store.is_fresh(manifest, "W", now + timedelta(days=6)) and not store.is_fresh(manifest, "D", now + timedelta(days=2))
    assert store.read_table(spark, path, fresh=("D", now + timedelta(days=2))) is None and store.read_table(spark, path, fresh=("D", now)).count() == 50
    victim = next((tmp_path / "t" / manifest["folder"]).glob("*.parquet"))
    victim.with_name(f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes()[:-1] + b"x")
    assert store.audit_table(spark, path).first().issue == "altered"
    with pytest.raises(store.StoreError, match="altered"):
        store.read_table(spark, path, digests=True)
    victim.unlink()
    with pytest.raises(store.StoreError, match="missing"):
        store.read_table(spark, path)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_table(spark.range(3), path, "v1")
    with pytest.raises(Exception, match="boom"):
        store.write_table(spark.range(4).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path, "v1")
    assert store.read_table(spark, path, digests=True).count() == 3
    first = store.read_manifest(spark, path)["folder"]
    for n in (4, 5):
        store.write_table(spark.range(n), path, "v1", pipeline_processed=True)
    assert store.read_table(spark, path).count() == 5 and store.read_manifest(spark, path)["meta"] == {"pipeline_processed": True}
    assert not (tmp_path / "t" / first).exists() and len(list((tmp_path / "t").glob("data-*"))) == 2


def test_registry_and_models(spark, tmp_path):
    r = store.Registry(spark, str(tmp_path / "root"))
    with pytest.raises(store.StoreError, match="not in"):
        r.path("a")
    store.Registry(spark, str(tmp_path / "root")).write("a", spark.range(2), "v1")
    assert r.read("a").count() == 2 and list(r.names()) == ["a"]
    panel = spark.createDataFrame([("x", D(2020, 1, 1), 1.0), ("x", D(2020, 2, 1), 2.0)], "k string, p date, v double")
    m = r.write_vintages("v", panel, ["k"], "p", "v1")
    assert m["meta"] == {"vintages": True, "first_published": "2020-01-01", "last_published": "2020-02-01", "rows": 2}
    made = []
    build = lambda: made.append(1) or spark.range(7)
    assert r.build_or_read("b", build, "v1").count() == 7 and r.build_or_read("b", build, "v1").count() == 7 and len(made) == 1
    rng = np.random.default_rng(1)
    model = regime.fit_markov(rng.normal(size=(60, 2)), states=2, rounds=3)
    path = str(tmp_path / "m.json")
    regime.save_markov(spark, model, ["a", "b"], path)
    held = regime.load_markov(spark, path, ["a", "b"])
    assert np.array_equal(held.centres, model.centres) and held.log_likelihoods == model.log_likelihoods
    for features, spoil in ((["b", "a"], None), (["a", "b"], lambda t: t.replace('"version": "1"', '"version": "2"')), (["a", "b"], lambda t: t.replace("0.", "1.", 1)), (["a", "b"], lambda t: t[:-9])):
        if spoil:
            regime.save_markov(spark, model, ["a", "b"], path)
            text = spoil((tmp_path / "m.json").read_text())
            (tmp_path / ".m.json.crc").unlink(missing_ok=True)
            (tmp_path / "m.json").write_text(text)
        with pytest.raises(store.StoreError):
            regime.load_markov(spark, path, features)


def test_stream_of_revisions(spark, tmp_path):
    schema = "indicator_id string, area_code string, obs_date date, value double, realtime_start timestamp"
    rows = [("i", "a", D(2020, 1, 1), 1.0, datetime(2020, 2, 1)), ("i", "a", D(2020, 1, 1), 1.0, datetime(2020, 2, 1)), ("i", "a", D(2020, 1, 1), 2.0, datetime(2020, 2, 3))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = revisions.fresh_revisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    revisions.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def book(path, sheets):
    """A small workbook: sheets maps a name to rows of cells, numbers and shared strings."""
    import zipfile
    from xml.sax.saxutils import escape

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared: list[str] = []

    def cell(r, c, v):
        at = f"{chr(65 + c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for n, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{n + 1}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name="{s}" sheetId="{n + 1}" r:id="rId{n + 1}"/>' for n, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="rId{n + 1}" Type="t" Target="worksheets/sheet{n + 1}.xml"/>' for n in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{escape(s)}</t></r></si>" for s in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    day = lambda d: (d - D(1899, 12, 30)).days
    narrow = [["title"], ["date", "r", "g"], [day(D(2020, 1, 1)), 1.5, "n/a"], [day(D(2020, 1, 1)), 2.5, 3], ["note"], [day(D(2020, 4, 1)), 9, 9]]
    wide = [["title"], ["date", None, "g", "r"], [day(D(2020, 4, 1)), None, 4, 5]]
    book(tmp_path / "v.xlsx", {"readme": [["2020"]], "2020Q1": narrow, "2020Q2": wide})
    cells = workbooks.workbook(spark, str(tmp_path))
    assert cells.where("sheet = 'readme'").first().text == "2020"
    got = {tuple(r) for r in workbooks.vintage_sheets(cells, {3: {"r": 1, "g": 2}, 4: {"g": 2, "r": 3}}, skip=2).collect()}
    assert got == {("2020Q1", D(2020, 1, 1), "r", 2.5), ("2020Q1", D(2020, 1, 1), "g", 3.0), ("2020Q2", D(2020, 4, 1), "g", 4.0), ("2020Q2", D(2020, 4, 1), "r", 5.0)}
    with pytest.raises(Exception, match="no layout for 2020Q2"):
        workbooks.vintage_sheets(cells, {3: {"r": 1, "g": 2}}, skip=2).collect()
    book(tmp_path / "p.xlsx", {"d": [[], [], [], ["day", "l", "s"], [day(D(2020, 1, 7)), 5, 2], [day(D(2020, 1, 14)), None, 2]]})
    positions = workbooks.workbook(spark, str(tmp_path / "p.xlsx"))
    assert sorted(tuple(r) for r in workbooks.net_positions(positions, [1], [2]).collect()) == [(D(2020, 1, 7), 3.0), (D(2020, 1, 14), -2.0)]


def test_loaders_fail_alone(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("time,close\n2024-01-03,12\n")
    (tmp_path / "ZZZ.csv").write_text("time,close\n2024-01-03,12\n")
    got = readers.chart_files(spark, str(tmp_path), {"ABC": {"id": "A", "scale": 10.0, "unit": "USD"}, "NONE": {"id": "N"}})
    assert [tuple(r) for r in got.series.collect()] == [("A", D(2024, 1, 3), 120.0)]
    assert got.metadata == {"A": {"id": "A", "scale": 10.0, "unit": "USD", "tier": 5}} and got.failed == {"ZZZ": "not registered", "N": "no file"}
    good = spark.createDataFrame([(D(2020, 1, 1), 1.0)], "obs_date date, value double")
    whole = readers.load_all(spark, {"a": lambda: good, "b": lambda: spark.read.parquet(str(tmp_path / "nowhere")), "c": lambda: good.limit(0)}, {"a": {"unit": "pct"}})
    assert [r.id for r in whole.series.collect()] == ["a"] and whole.metadata == {"a": {"unit": "pct"}} and set(whole.failed) == {"b", "c"}
    assert readers.load_all(spark, {}).series.count() == 0


def test_closes_and_reserves(spark):
    flat = spark.createDataFrame([("2024-01-01", 1.0)], "d string, Close double")
    two = spark.createDataFrame([("2024-01-01", 1.0, None)], "d string, `Close|A` double, `Close|B` double")
    assert [tuple(r) for r in readers.closes(flat, "d").collect()] == [("Close", D(2024, 1, 1), 1.0)] == [("Close", *r[1:]) for r in map(tuple, readers.closes(two, "d").collect())]
    with pytest.raises(ValueError):
        readers.closes(flat.select("d"), "d")
    wide = spark.createDataFrame([("World", "RAX_USD", "1.5"), ("World", "RAX", "9"), ("Chad", "RAX_EUR", "2")], "area string, series_code string, `2003-Q1` string")
    assert [tuple(r) for r in readers.reserves(wide).collect()] == [("USD", D(2003, 1, 1), 1.5)]


def test_gates_from_the_command_line(spark, capsys):
    from tidegauge.__main__ import main

    assert main([]) == 2 and main(["nowhere", "/root/testdata/sf0.001"]) == 2
    code = main(["market_close", "/root/testdata/sf0.001"])
    shown = capsys.readouterr().out
    assert "market_close: close positive" in shown and code == ("FAIL" in shown)
