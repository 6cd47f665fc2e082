import datetime as dt
import random

import pytest
from conftest import rows

from limnokit.session import settle, shared_dir
from limnokit.sources import tables
from limnokit.sources.schemas import TABLES, table_schema

CSV = """"Vial_num","Site","Extra","Sample_Date","Inc_month","Spike_µg_L","AFDM_g","OM_.","Location"
1,"GB3m",9,"2023-05-24","May",100,0.5,1.5,"GB"
2,"NA",9,"2023-5-4","",NA,0,oops,"BW"
"""


def test_csv_is_matched_by_header(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV, encoding="utf-8")
    df = tables.read_table(spark, str(path), "incubation_raw", "csv")
    assert df.schema.simpleString() == table_schema("incubation_raw").simpleString()
    a, b = df.orderBy("vial_num").collect()
    assert (a.site, a.sample_date, a.spike_ug_l, a.om_percent) == ("GB3m", dt.date(2023, 5, 24), 100.0, 1.5)
    # Missing text, blank text, lenient date, missing and unreadable numbers
    assert (b.site, b.inc_month, b.sample_date, b.spike_ug_l, b.om_percent) == (None, "", dt.date(2023, 5, 4), None, None)
    assert a.conc_mgn_l is None and a.type is None
    with pytest.raises(ValueError):
        tables.read_table(spark, str(path), "incubation_raw", "xlsx")


def test_files_with_other_column_orders_line_up(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("Shore,Inc_month,Temp_degC,pH\nE,May,10,8\n")
    two.write_text("pH,Temp_degC,Inc_month,Shore\n7,11,May,W\n")
    both = tables.union_tables([tables.read_csv_table(spark, str(p), "lake_ph_temp") for p in (one, two)])
    assert rows(both) == [("E", "May", 10.0, 8.0), ("W", "May", 11.0, 7.0)]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('Shore,Inc_month,Temp_degC,pH\nE,May,10,8\n"He said ""no"", then\nleft",June,n.d.,x\nW,July,1\n')
    (tmp_path / "c.csv").write_bytes('\ufeffpH,Temp_degC,Extra,Inc_month,Shore\r\n7,11,"a,b",May,W\r\n6,,,NA,\r\n1,2,3,4,5,6\r\n'.encode())
    (tmp_path / "d.csv").write_text("pH,Shore\n")
    scan = tables.scan_csv(spark, [str(tmp_path / n) for n in ("a b.csv", "c.csv", "d.csv")], "lake_ph_temp")
    want = [("", None, None, 6.0), ("E", "May", 10.0, 8.0), ('He said "no", then\nleft', "June", None, None), ("W", "May", 11.0, 7.0)]
    assert rows(scan.rows) == rows(spark.createDataFrame(want, table_schema("lake_ph_temp")))
    assert {r["column"]: r["n"] for r in scan.faults.collect()} == {"temp_deg_c": 1, "ph": 1, "(record)": 2}
    assert rows(tables.read_table(spark, str(tmp_path), "lake_ph_temp", "csv")) == rows(scan.rows)
    assert scan.rows.count() == 4 and scan.rows.select("shore").count() == 4
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("\n")
    empty = tables.scan_csv(spark, str(tmp_path / "none"), "lake_ph_temp")
    assert (empty.rows.count(), empty.faults.count()) == (0, 0) and empty.rows.schema == table_schema("lake_ph_temp")
    (tmp_path / "broken.csv").write_text('"Sh\nore",pH\n1,2\n')
    with pytest.raises(ValueError):
        tables.scan_csv(spark, str(tmp_path / "broken.csv"), "lake_ph_temp")


def test_any_text_survives_a_csv_file(spark, tmp_path):
    """Quotes, separators, line ends, backslashes and white space in random texts."""
    r = random.Random(2)
    texts = ["".join(r.choice('",\n\r\\\t #;\'aé漢') for _ in range(r.randrange(8))) for _ in range(400)] + ['"', '""', '\\"', "\n", " ", "", "\r\n", "\r"]
    df = spark.createDataFrame([(t, str(i), float(i), None) for i, t in enumerate(texts)], table_schema("lake_ph_temp")).repartition(3)
    tables.write_csv(df, str(tmp_path / "csv"))
    got = {r.inc_month: r.shore for r in tables.read_table(spark, str(tmp_path / "csv"), "lake_ph_temp", "csv").collect()}
    assert got == {str(i): t for i, t in enumerate(texts)}


def test_csv_and_parquet_round_trip(spark, tmp_path):
    data = [("a,b", "May", 1.5, None), (None, "", None, 7.0), ('q"x', "J", 2.0, 0.1)]
    df = spark.createDataFrame(data, table_schema("lake_ph_temp"))
    tables.write_csv(df, str(tmp_path / "csv"))
    assert rows(tables.read_table(spark, str(tmp_path / "csv"), "lake_ph_temp", "csv")) == rows(df)
    tables.write_parquet(df, str(tmp_path / "pq"), partition_by=["inc_month"])
    back = tables.read_table(spark, str(tmp_path / "pq"), "lake_ph_temp")
    assert sorted(r.shore or "" for r in back.collect()) == ["", "a,b", 'q"x']
    tables.write_parquet(df, str(tmp_path / "plain"))
    assert rows(tables.read_table(spark, str(tmp_path / "plain"), "lake_ph_temp")) == rows(df)


def test_drop_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert tables.drop_column_at(df, 2).columns == ["a", "c"]


def test_settled_tables_live_in_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "id / 3.0 as v")
    kept = settle(df, "probe")
    assert rows(kept) == rows(df)
    assert all(shared_dir(spark).replace("file:", "") in f.replace("file://", "") for f in kept.inputFiles())


def test_schemas_are_ascii_and_unique():
    for table, columns in TABLES.items():
        assert all(name.isascii() and name == name.lower() for name in columns), table
        headers = [h for _, h in columns.values()]
        assert len(set(headers)) == len(headers)


def test_stages_hand_on_every_column(spark, tmp_path):
    """Raw readings to ammonium, rates and curves, each stage written and read back by its layout."""
    from limnokit.plans.rates import RATE_COLUMNS, uptake_rates
    from limnokit.plans.speciation import convert_ammonium
    from limnokit.plans.workflows import rates_to_fits

    base = dict.fromkeys(TABLES["incubation_raw"]) | {
        "sample_date": dt.date(2023, 5, 24), "inc_month": "May", "site": "GB3m", "location": "GB", "analyte": "NO3", "depth": 3.0,
        "actual_incubation_hrs": "6:30", "volume_lake_water_l": 0.1, "weight_g": 2.0, "afdm_g": 0.5, "om_percent": 1.0,
    }
    raw, vial = [], 0
    for dose in (0.0, 100.0, 200.0, 400.0, 800.0):
        for kind, drop in (("spike", 0.0), ("water", 0.001), ("sediment", 0.03 * dose / (150.0 + dose))):
            vial += 1
            raw.append({**base, "vial_num": vial, "type": kind, "spike_ug_l": dose, "no2_no3_mgn_l": 0.05 + dose / 1000 - drop})

    def handed(df, name):
        tables.write_parquet(df, str(tmp_path / name))
        back = tables.read_table(spark, str(tmp_path / name), name)
        assert set(back.columns) == set(df.columns) == set(TABLES[name])
        assert rows(back.select(*df.columns)) == rows(df)
        return back

    schema = table_schema("incubation_raw")
    readings = handed(spark.createDataFrame([tuple(r[f.name] for f in schema) for r in raw], schema), "incubation_raw")
    lake = handed(spark.createDataFrame([("E", "May", 15.0, 8.0)], table_schema("lake_ph_temp")), "lake_ph_temp")
    converted = handed(convert_ammonium(readings, lake), "incubation_nh4")
    rates = handed(uptake_rates(converted), "uptake_rates")
    assert rates.columns == RATE_COLUMNS and rates.count() == 5
    fits = rates_to_fits(rates, [])
    curves = handed(fits.saturation, "fit_mm")
    handed(fits.linear, "fit_linear")
    assert [r.model_name for r in curves.collect()] == ["GB3m_May_sediment_NO3"]
