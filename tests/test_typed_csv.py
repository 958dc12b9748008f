"""A1/A2 from CSV: types from the values, rejected rows, and the enriched flow."""
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from riskweave.operators import rollup
from riskweave.operators.ml import feature_lists
from riskweave.operators.profile import correlation_top
from riskweave.plans import jobs
from riskweave.sources import adapters as A
from riskweave.sources.io import SourcesConfig, SourceSpec, load_sources, read_table
from riskweave.sources.typed_csv import ColumnCounts, column_counts, read_csv
from tests.conftest import SMOKE


def write(path, text):
    path.mkdir()
    for i, part in enumerate(text if isinstance(text, list) else [text]):
        (path / f"part-{i}.csv").write_text(part)
    return str(path)


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_types_come_from_the_values(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'i,d,b,s,e,big,n,pad,mixed\n1,1.5,True,x,,99999999999999999999,NA, 7 ,1\n-2,1e3,false,"a,b",,1,3,8,2.0\n'
                 '+3,-.5,TRUE,"say ""hi""",NaN,2,nan,9,x\n')
    rows, rejected = read_csv(spark, path)
    assert kinds(rows) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "double", "big": "double", "n": "bigint",
                           "pad": "bigint", "mixed": "string"}
    assert [tuple(r) for r in rows.orderBy("pad").collect()] == [
        (1, 1.5, True, "x", None, 1e20, None, 7, "1"), (-2, 1000.0, False, "a,b", None, 1.0, 3, 8, "2.0"), (3, -0.5, True, 'say "hi"', None, 2.0, None, 9, "x")]
    assert rejected.count() == 0


def test_no_truncation_and_no_suffixes(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b,c\n1.0,1d,0x10\n2,2f,3\n")
    assert kinds(read_csv(spark, path)[0]) == {"a": "double", "b": "string", "c": "string"}
    path = write(tmp_path / "u.csv", "a\n1.5\ninf\n-Infinity\n")
    assert [r[0] for r in read_csv(spark, path)[0].orderBy("a").collect()] == [float("-inf"), 1.5, float("inf")]


def test_counts_of_parts_add_up(spark, tmp_path):
    parts = ["a,b\n1,x\n2.5,\n", "a,b\n,3\n7,true\n"]
    whole = column_counts(read_csv(spark, write(tmp_path / "w.csv", parts), schema="a string, b string")[0])
    each = [column_counts(read_csv(spark, write(tmp_path / f"p{i}.csv", p), schema="a string, b string")[0]) for i, p in enumerate(parts)]
    assert whole == {c: each[0][c] + each[1][c] for c in "ab"}
    assert whole["a"] == ColumnCounts(3, 2, 3, 0) and whole["a"].kind() == T.DoubleType()
    assert ColumnCounts(0, 0, 0, 0).kind() == T.DoubleType()


def test_rows_that_do_not_fit_are_rejected(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,v,w\n" + "".join(f"{i},{i}.5,k\n" for i in range(50)) + "x,1.0,k\n60,?,k\n61,2\n62,1,k,extra\n")
    rows, rejected = read_csv(spark, path, tolerance=0.05)
    assert kinds(rows) == {"id": "bigint", "v": "double", "w": "string"} and rows.count() == 50
    got = {(r["row"], r["column"], r["value"], r["reason"]) for r in rejected.collect()}
    assert got == {("x,1.0,k", "id", "x", "not a bigint"), ("60,?,k", "v", "?", "not a double"), ("61,2", None, "61,2", "number of fields"),
                   ("62,1,k,extra", None, "62,1,k,extra", "number of fields")}
    # aggregates and single columns see the same rows: the parser may not skip fields
    assert rows.select("w").count() == 50 and rows.groupBy().sum("id").first()[0] == sum(range(50))
    assert read_table(spark, path, tolerance=0.05, rejects_path=str(tmp_path / "rejects")).count() == 50
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 4
    with pytest.raises(PySparkException, match="does not fit"):
        read_table(spark, path, tolerance=0.05).count()


def test_declared_types_win_and_their_misfits_are_rejected(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,code,day\n1,007,2001-01-02\n2,8,soon\n")
    rows, rejected = read_csv(spark, path, schema="code string, day date")
    assert kinds(rows) == {"id": "bigint", "code": "string", "day": "date"}
    assert [r["code"] for r in rows.collect()] == ["007"]
    assert [(r["column"], r["value"]) for r in rejected.collect()] == [("day", "soon")]
    with pytest.raises(ValueError, match="not in"):
        read_csv(spark, path, schema="nope long")


def test_headers_empty_tables_and_odd_names(spark, tmp_path):
    rows, rejected = read_csv(spark, write(tmp_path / "e.csv", "a,b\n"))
    assert kinds(rows) == {"a": "double", "b": "double"} and rows.count() == 0 and rejected.count() == 0
    rows, _ = read_csv(spark, write(tmp_path / "n.csv", "a.b,c`d,row\n1,2,x\n"))
    assert [tuple(r) for r in rows.collect()] == [(1, 2, "x")] and rows.columns == ["a.b", "c`d", "row"]
    with pytest.raises(Exception, match="header"):
        read_csv(spark, write(tmp_path / "h.csv", ["a,b\n1,2\n", "b,a\n1,2\n"]))[0].collect()


def test_operators_see_numbers(spark, tmp_path):
    path = str(tmp_path / "app.csv")
    A.application(spark, SMOKE).write.option("header", True).csv(path)
    df = read_table(spark, path)
    assert feature_lists(df) == feature_lists(A.application(spark, SMOKE))
    assert correlation_top(df).count() == correlation_top(A.application(spark, SMOKE)).count() > 0


def test_enriched_from_csv_equals_parquet(spark, tmp_path):
    tables = {"base": A.application(spark, SMOKE)} | A.lending_sources(spark, SMOKE)
    cfgs = []
    for fmt in ("csv", "parquet"):
        for name, df in tables.items():
            df.write.option("header", True).format(fmt).save(str(tmp_path / f"{name}.{fmt}"))
        cfgs.append(SourcesConfig(str(tmp_path / f"base.{fmt}"), {n: SourceSpec(str(tmp_path / f"{n}.{fmt}")) for n in tables if n != "base"}))
    paths = [jobs.build_features(spark, cfg, str(tmp_path / f"out{i}")) for i, cfg in enumerate(cfgs)]
    one, two = (read_table(spark, p) for p in paths)
    assert one.columns == two.columns and len(one.columns) == 39
    from tests.oracle_runner import digest
    assert digest(one.columns, [tuple(r) for r in one.collect()])[0] == digest(two.columns, [tuple(r) for r in two.collect()])[0]


def test_base_table_takes_a_schema_and_rejects(spark, tmp_path):
    base = write(tmp_path / "base.csv", "SK_ID_CURR,TARGET\n1,0\n2,1\nx,1\n")
    cfg = SourcesConfig(base, base_schema="SK_ID_CURR long", rejects_dir=str(tmp_path / "bad"))
    df, sources = load_sources(spark, cfg)
    assert df.count() == 2 and sources == {} and spark.read.parquet(str(tmp_path / "bad" / "base")).first()["row"] == "x,1"
    assert rollup.enrich_applications(df, {}, skip_empty=True).count() == 2


def test_a_value_is_parsed_once_and_strict_reads_still_fail(spark, tmp_path):
    path = write(tmp_path / "t.csv", "i,d,s\n1,1.5,x\n2,2,y\n")
    rows, _ = read_csv(spark, path, strict=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("RLIKE") == 3                                      # before: 6, in the filter and in the projection
    assert [tuple(r) for r in rows.orderBy("i").collect()] == [(1, 1.5, "x"), (2, 2.0, "y")]
    (tmp_path / "t.csv" / "part-0.csv").write_text("i,d,s\n1,1.5,x\n2,oops,y\n")
    with pytest.raises(PySparkException):
        rows.collect()                                                           # changed since its types were found
    with pytest.raises(PySparkException):
        read_csv(spark, path, schema="d double", strict=True)[0].collect()


def test_counts_of_every_kind_of_value(spark, tmp_path):
    values = ["1", "-2", "99999999999999999999", "1.5", "1e3", "inf", "-Infinity", "true", "FALSE", "x", "NA", "1d"]
    path = write(tmp_path / "k.csv", "a\n" + "\n".join(values) + "\n")
    assert column_counts(read_csv(spark, path, schema="a string")[0]) == {"a": ColumnCounts(11, 2, 7, 2)}
