"""Every query of the catalog against its SQL on the smallest tables, and what surrounds them."""

import os

import pytest

from inkledger import sources, streaming
from inkledger.operators import tiles
from inkledger.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].astype("datetime64[us]").astype(str) if str(frame[c].dtype).startswith("datetime") else frame[c]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differing(got, want):
    """Columns of two ordered frames that differ in some row; nulls equal nulls and nothing else."""
    return [c for c in got.columns if not ((got[c] == want[c]).fillna(False).astype(bool) | (got[c].isna() & want[c].isna())).all()]


def test_a_null_differs_from_a_value():
    import pandas as pd

    for kind in ("Int32", "Int64", "float64", "object", "boolean"):
        one = pd.DataFrame({"x": pd.array([1, None], dtype=kind) if kind != "boolean" else pd.array([True, None], dtype=kind)})
        filled = pd.DataFrame({"x": pd.array([one.x[0]] * 2, dtype=kind)})
        for other in (one.iloc[::-1].reset_index(drop=True), filled):
            assert differing(one, other) == differing(other, one) == ["x"]
        assert differing(one, one.copy()) == []
    assert differing(pd.DataFrame({"x": [0.0, 1.0]}), pd.DataFrame({"x": pd.array([None, 1], dtype="Int32")})) == ["x"]


def test_every_query_has_sql():
    assert set(catalog.queries()) - catalog.WITHOUT_SQL == set(SQL)


def test_queries_without_sql_give_rows(spark, sf):
    """Their operators are tested against plain loops in ``test_scans``."""
    for name in catalog.WITHOUT_SQL:
        assert catalog.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    got, want = ordered(catalog.queries()[name](spark, sf).toPandas()), ordered(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert differing(got, want) == []


def test_pushdown(spark, sf):
    """Filters and columns reach the scans."""
    plan = catalog.teacher_assignments(spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "ReadSchema" in x]
    orders = next(x for x in scans if "o_orderkey" in x)
    assert "EqualTo(o_orderstatus,F)" in orders and "o_totalprice" in orders
    customer = next(x for x in scans if "c_custkey" in x)
    assert "EqualTo(c_mktsegment,BUILDING)" in customer and "c_acctbal" not in customer and "c_name" in customer


@pytest.mark.parametrize("name,scans", [("stylometry", 1), ("ai_probability", 1), ("style_score", 1)])
def test_signals_of_a_text_take_one_scan_and_no_exchange(spark, sf, name, scans):
    plan = report_plan(catalog.queries()[name](spark, sf))
    assert plan.count("FileScan") == scans and "Exchange" not in plan


def test_flags_read_what_is_written_once(spark, sf):
    """What is left to run after signals, scores and evidence are written."""
    plan = report_plan(catalog.final_flags(spark, sf))
    assert plan.count("FileScan") == 0 and plan.count("Exchange") < 15


@pytest.mark.parametrize("name", ["copy_flags", "final_flags", "flag_summary", "full_report"])
def test_scores_and_flags_share_packed_sets(spark, sf, monkeypatch, name):
    """The word sets of all texts are packed once for scores and flags, and the shuffle of their counts is freed."""
    packs, written, plain, keep = [], [], tiles.packed, tiles.durable
    monkeypatch.setattr(tiles, "packed", lambda *a, **b: packs.append(a[2:]) or plain(*a, **b))
    monkeypatch.setattr(tiles, "durable", lambda df: written.append(df.columns) or keep(df))
    catalog.queries()[name](spark, sf)
    assert packs == [("items",)] and ["range", "bits", "items_v", "items_c"] in written


def report_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, sf, tmp_path):
    events = sources.table(spark, sf, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming.window_counts(streaming.event_stream(spark, str(tmp_path / "in"), events.schema), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, streaming.window_counts(events).collect()))


def test_scan_of_arrivals(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    arrivals = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    streaming.scan_arrivals(arrivals, lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"no")
    (row,) = sources.pdf_files(spark, str(tmp_path)).collect()
    assert row.length == 6 and len(row.md5) == 32 and row.ingest_status == "ok"
    (row,) = sources.pdf_files(spark, str(tmp_path), most=5).collect()
    assert row.length == 6 and row.content is None and row.ingest_status == "too large"
    rows = spark.createDataFrame([(1, "[0.5, 1]"), (2, "bad")], "id long, v string")
    assert [r.v for r in sources.fingerprints_json(rows, "v").orderBy("id").collect()] == [[0.5, 1.0], None]
    assert [r.id for r in sources.new_rows(rows, rows.where("id = 1"), "id").collect()] == [2]
    for more in (rows, rows.unionAll(rows.selectExpr("id + 1", "v"))):
        sources.insert(more, str(tmp_path / "table"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2, 3]
    sources.write_fingerprints(sources.fingerprints_json(rows, "v"), str(tmp_path / "fp"), vector="v")
    assert [tuple(r) for r in spark.read.schema("id long, v array<double>").json(str(tmp_path / "fp")).collect()] == [(1, [0.5, 1.0])]
    sources.write_report(rows.withColumnRenamed("id", "rank"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_entry_without_the_training_subpackage(tmp_path):
    """A copy without the optional folders imports and lists the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "inkledger", tmp_path / "inkledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.llm is None; q = e.queries(); assert len(q) > 50 and set(q) - e.catalog.WITHOUT_SQL == set(e.oracle_sql()), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_without_a_package_of_the_training_operators(tmp_path):
    """The other queries stay if a module that the optional ones import is missing."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    if not (root / "corpus_pipeline.py").exists():
        pytest.skip("the optional folders are gone")
    (tmp_path / "xxhash.py").write_text("raise ImportError('gone')")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(root)!r}]; import __spark_entry__ as e; q = e.queries(); assert e.llm is None and len(q) > 50 and set(q) - e.catalog.WITHOUT_SQL == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
