import pytest

from staffwise.functions.clean import convert_occ
from staffwise.sources import exports, sinks

OCC = ["date_text", "language", "usd", "level", "req_media", "occ"]


def _write(folder, name, *lines):
    (folder / name).write_text("".join(x + "\n" for x in lines), encoding="utf-8")


def test_exports_by_prefix_with_differing_headers(spark, tmp_path):
    _write(tmp_path, "HMO-OCC-1.csv", "date_text,language,usd,level,req_media,occ", "13-02-2025,SPANISH,USD,L4,Video,79.5%")
    _write(tmp_path, "HMO-OCC-2.csv", "occ,level,usd,language,date_text,req_media,note",
           '0.5,L3,Global,"KOREAN, SOUTH",2025-02-14,OPI,x', "bad,L3,Global,KOREAN,nonsense,OPI,")
    _write(tmp_path, "HMO-Calls.csv", "a,b", "1,2")
    got = exports.read_exports(spark, str(tmp_path), {"HMO-OCC": OCC})["HMO-OCC"]
    assert sorted(got.columns) == sorted([*OCC, "note"])
    rows = {r.language: (str(r.date), r.req_media, r.occ) for r in convert_occ(got).collect()}
    assert rows == {"SPANISH": ("2025-02-13", "VIDEO", 79.5), "KOREAN, SOUTH": ("2025-02-14", "OPI", 0.5),
                    "KOREAN": ("None", "OPI", None)}


def test_missing_file_or_column_raises(spark, tmp_path):
    _write(tmp_path, "HMO-OCC.csv", "date_text,language", "1,2")
    with pytest.raises(ValueError, match="HMO-FTE"):
        exports.read_exports(spark, str(tmp_path), {"HMO-OCC": ["language"], "HMO-FTE": []})
    with pytest.raises(ValueError, match="occ"):
        exports.read_exports(spark, str(tmp_path), {"HMO-OCC": OCC})


def test_datamart_is_pruned_by_language_and_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "dm")
    df = spark.createDataFrame([("007", 1.5), ("A B", None)], "language string, demand double")
    sinks.write_datamart(df, path)
    back = sinks.read_datamart(spark, path, df.schema)
    assert set(map(tuple, back.select("language", "demand").collect())) == {("007", 1.5), ("A B", None)}
    plan = back.where("language = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_datamart(df, path)


def test_report_and_log(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"", None, 0.1), ("", 2, None)], "name string, n int, x double")
    sinks.write_report(df, str(tmp_path / "r"))
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "r"))
    assert {r.n: (r.name, r.x) for r in back.collect()} == {None: ('a,"b"', 0.1), 2: (None, None)}
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
