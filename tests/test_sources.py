"""Scans, sinks, messages and stored artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge import session
from tidegauge.sources import artifacts, events as EV, html, tables as TB


def test_event_csv_with_quotes_newlines_and_bad_time(spark, tmp_path):
    header = ",".join(n for n, _ in EV.EVENT_COLUMNS)
    text = ('2015-02-24 11:35:52 +0000,1,negative,0.9,,,Delta,,bob,,0,"a ""quoted"",\nline",,,\n'
            'not a time,2,positive,1.0,,,Delta,,ann,,3,plain,,,\n'
            '2015-02-25 11:35:52 +0000,3,neutral,1.0,,,Delta,,ann,,3,plain,,,\n')
    (tmp_path / "e.csv").write_text(header + "\n" + text)
    got = {r.tweet_id: r for r in EV.read_events(spark, str(tmp_path)).collect()}
    assert got[1].text == 'a "quoted",\nline' and got[2].tweet_created is None
    assert got[3].retweet_count == 3
    inside = EV.read_events(spark, str(tmp_path), "2015-02-24 11:35:52", "2015-02-26").collect()
    assert [r.tweet_id for r in inside] == [3]


def test_offset_bounds_are_exclusive_and_optional(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-05', "
                   "interval 1 day)) AS ts")
    assert EV.offset_range(df, "ts").count() == 5
    assert EV.offset_range(df, "ts", "2024-01-01", "2024-01-05").count() == 3
    last = df.agg(F.max("ts")).scalar()
    assert EV.offset_range(df, "ts", end=last).count() == 4


def test_offset_filter_reaches_the_scan(spark, sf):
    df = EV.offset_range(TB.table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-01-10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "props" not in plan.split("ReadSchema")[1]


def test_append_and_high_water_mark(spark, tmp_path):
    path = str(tmp_path / "data")
    for day in ("2024-01-01", "2024-01-02"):
        EV.append_data(spark.sql(f"SELECT timestamp_ntz'{day} 00:00:00.9' AS ts"), path)
    row = EV.high_water_mark(spark.read.parquet(path), "ts").first()
    assert row.original == 1704153600


def test_retime_moves_the_newest_to_the_anchor(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2015-01-01'), (timestamp_ntz'2015-01-03') t(ts)")
    got = [str(r.ts) for r in EV.retime(df, "ts", "2024-06-01").orderBy("ts").collect()]
    assert got == ["2024-05-30 00:00:00", "2024-06-01 00:00:00"]


def test_message_round_trip(spark):
    df = spark.createDataFrame(
        [(1, 'say "hi", [ok]\n\\', None, 0.5, "negative"), (2, "ü", 7, None, None)],
        "id bigint, text string, n int, x double, s string").withColumn(
        "ts", F.lit("2024-01-01 10:20:30").cast("timestamp_ntz"))
    body = df.select(EV.to_message(df, "ts", ["id", "text", "n", "x", "s"]).alias("body"))
    arrays = [json.loads(r.body) for r in body.collect()]
    assert arrays[0] == ["2024-01-01 10:20:30+0000", 1, 'say "hi", [ok]\n\\', None, 0.5, "negative"]
    got = EV.from_message(body, "body", [("id", "bigint"), ("text", "string"), ("n", "int"),
                                         ("x", "double"), ("s", "string")], "s")
    rows = got.orderBy("id").collect()
    assert rows[0].text == 'say "hi", [ok]\n\\' and rows[0].n is None and rows[0].sentiment == -1
    assert rows[1].n == 7 and rows[1].sentiment is None
    assert str(rows[0].ts) == "2024-01-01 10:20:30"


def test_epoch_and_malformed_messages(spark):
    df = spark.createDataFrame([('[1704104430, "5"]',), ('["garbage", "x"]',), ("{broken",)],
                               "body string")
    got = EV.from_message(df, "body", [("id", "bigint")]).collect()
    assert [str(r.ts) for r in got] == ["2024-01-01 10:20:30", "None", "None"]
    assert [r.id for r in got] == [5, None, None]


def test_html_tables(spark):
    page = ("<TABLE class=x><tr><th>A</th><th>B</th></tr><tr><td> 1 <b>bold</b></td><td>2\n3</td></tr>"
            "</TABLE><p>no</p><table><tr><td>z</td></tr></table>")
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    got = [tuple(r) for r in TB.html_tables(df).orderBy("table_no", "row_no", "cell_no").collect()]
    assert got == [(1, 0, 0, 0, "A"), (1, 0, 0, 1, "B"), (1, 0, 1, 0, "1 bold"), (1, 0, 1, 1, "2 3"),
                   (1, 1, 0, 0, "z")]


def grid(spark, page):
    """Tables of a page as lists of rows."""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    out = {}
    for r in html.html_grids(df).orderBy("table_no", "row_no", "cell_no").collect():
        rows = out.setdefault(r.table_no, {})
        row = rows.setdefault(r.row_no, [])
        assert r.cell_no == len(row)  # no hole before it
        row.append(r.cell)
    return [list(out[t].values()) for t in sorted(out)]


@pytest.mark.parametrize("page,want", [
    # a nested table is one of its own, entities are decoded, the cell after it is not lost
    ("<table><tr><td>a &amp; b<table><tr><td>in</td></tr></table></td><td>c</td></tr></table>", [[["a & b", "c"]], [["in"]]]),
    ("<table><tr><td>1<td>2</tr><tr><td>3</table>", [[["1", "2"], ["3"]]]),
    ("<table><td>no row tag<tr><td>x</td></tr></table>", [[["no row tag"], ["x"]]]),
    ("<!-- <table><tr><td>no</td></tr></table> --><table><tr><td>a<!-- b --></td></tr></table>", [[["a"]]]),
    ("<table><tr><td colspan=2>w</td><td>x</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>", [[["w", "w", "x"], ["1", "2", "3"]]]),
    ("<table><tr><td rowspan='2'>t</td><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>", [[["t", "a"], ["t", "b"], ["c"]]]),
    ("<table><tr><td>a</td><td rowspan=3 colspan=2>B</td></tr><tr><td>b</td></tr></table>", [[["a", "B", "B"], ["b", "B", "B"]]]),
    ("<table><tr><th rowspan=0>all</th><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>", [[["all", "1"], ["all", "2"], ["all", "3"]]]),
    ("<table><tr><td colspan=x rowspan=-1>1</td><td colspan='0'>2</td></tr></table>", [[["1", "2"]]]),
    ("<TABLE><thead><TR><TH>A<tbody><TR><TD>1</TABLE>", [[["A"], ["1"]]]),
    ("<table><tr><td>x<script>var t = '<td>';</script><style>td{}</style><br>y</td></tr></table>", [[["x y"]]]),
    ("<table><tr><td>&eacute;&#33;&nbsp;&lt;td&gt;</td></tr></table>", [[["é! <td>"]]]),
    ("<table><tr></tr><tr><td></td></tr></table>", [[[""]]]),
    ("<table><tr><td>1</td></tr></table></table></td><table><tr><td>2", [[["1"]], [["2"]]]),
    ("<p>table</p>", []), ("<table", []), ("", []), (None, [])])
def test_html_grids(spark, page, want):
    assert grid(spark, page) == want


def test_html_grids_of_flat_pages_are_the_cells(spark):
    page = ("<TABLE class=x><tr><th>A</th><th>B</th></tr><tr><td> 1 <b>bold</b></td><td>2\n3</td></tr>"
            "</TABLE><p>no</p><table><tr><td>z</td></tr></table>")
    df = spark.createDataFrame([(1, page, "c"), (2, "<p>none</p>", "c"), (3, None, "c")], "page_id int, html string, cell string")
    assert sorted(map(tuple, html.html_grids(df).collect())) == sorted(map(tuple, TB.html_tables(df).collect()))
    assert html.html_grids(df.limit(0)).count() == 0


def test_whole_text_and_labelled_files(spark, tmp_path):
    for label, names in {"sick": "ab", "well": "c"}.items():
        (tmp_path / label).mkdir()
        for n in names:
            (tmp_path / label / f"{n}.txt").write_text("line 1\nline 2\n")
    files = TB.read_labelled_files(spark, str(tmp_path), "*.txt")
    assert {r.label: r["count"] for r in files.groupBy("label").count().collect()} == {
        "sick": 2, "well": 1}
    corpus = TB.read_text_corpus(spark, str(tmp_path / "sick")).collect()
    assert [r.text for r in corpus] == ["line 1\nline 2\n"] * 2


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a,"b"\nc', None), (2, None, 2.5)], "i int, s string, d double")
    back = TB.round_trip(df, str(tmp_path / fmt), fmt)
    assert back.orderBy("i").collect() == df.orderBy("i").collect()


def test_series_csv_coerces_dates(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,V\n1992-01-01,6938\nbad,1\n")
    got = TB.read_series_csv(spark, str(tmp_path), "DATE", "V").collect()
    assert [(str(r.ts), r.y) for r in got] == [("1992-01-01", 6938.0), ("None", 1.0)]


def test_artifacts(spark, tmp_path):
    root = str(tmp_path)
    fallback = spark.range(1)
    assert artifacts.load_artifact(spark, root, "x", fallback).count() == 1
    artifacts.save_artifact(spark.range(5), root, "x")
    artifacts.save_artifact(spark.range(3), root, "x")
    artifacts.append_artifact(spark.range(2), root, "x")
    assert artifacts.load_artifact(spark, root, "x", fallback).count() == 5
    artifacts.log_metric(spark, root, "r", "aic", 1, "2024-01-01 00:00:00")
    artifacts.log_metric(spark, root, "r", "aic", 2, "2024-01-02 00:00:00")
    newest = artifacts.load_artifact(spark, root, "metrics").agg(F.max_by("value", "ts")).first()[0]
    assert newest == 2.0


def test_readers_see_the_old_or_the_new_version(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifact(spark, root, "t")
    first = artifacts.save_artifact(spark.range(10), root, "t")
    reader = artifacts.load_artifact(spark, root, "t")
    cache = artifacts.Cache(spark, root)
    held = cache.load("t")
    assert cache.load("t") is held and artifacts.in_sync(spark, root, "t", first)
    # a table replaced by what is made from it; the reader goes on with what it opened
    second = artifacts.save_artifact(reader.where("id % 2 = 0"), root, "t")
    assert reader.count() == held.count() == 10 and not artifacts.in_sync(spark, root, "t", first)
    assert cache.load("t").count() == 5 and artifacts.load_artifact(spark, root, "t", version=first).count() == 10
    # a write that breaks off before it is published changes nothing
    with pytest.raises(Exception):
        artifacts.save_artifact(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), root, "t")
    assert artifacts.current(spark, root, "t")[0] == second
    path = tmp_path / "t" / "manifests" / f"{second + 1:09d}.json"
    path.write_text('{"folders": ["half')  # a manifest that is still being written
    assert artifacts.load_artifact(spark, root, "t").count() == 5
    third = artifacts.append_artifact(spark.range(2), root, "t")
    assert third == second + 2 and artifacts.load_artifact(spark, root, "t").count() == 7
    # of two writers that started from the same version one fails, and what is stored stays
    with pytest.raises(artifacts.OutOfDate):
        artifacts.save_artifact(spark.range(1), root, "t", expect=second)
    assert artifacts.load_artifact(spark, root, "t").count() == 7
    with pytest.raises(artifacts.OutOfDate):
        artifacts._publish(spark, root, "t", third, {"folders": []})
    assert artifacts.compact(spark, root, "t") == third + 1
    assert len(artifacts.current(spark, root, "t")[1]["folders"]) == 1
    assert artifacts.load_artifact(spark, root, "t").count() == 7


def test_metrics_of_a_run_are_one_write(spark, tmp_path):
    artifacts.log_metrics(spark, str(tmp_path), "r", {"a": 1, "b": 2.5}, "2024-01-01 00:00:00")
    rows = artifacts.load_artifact(spark, str(tmp_path), "metrics")
    assert sorted((r.run_id, r.name, r.value) for r in rows.collect()) == [("r", "a", 1.0), ("r", "b", 2.5)]
    assert len(rows.inputFiles()) == 1


def test_work_dir_follows_the_session(spark):
    assert session.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    spooled = session.spool(spark.range(10).withColumn("p", F.spark_partition_id()))
    assert spooled.count() == 10
    assert session.work_dir(spark) in spooled.inputFiles()[0]


def test_dummy_data(spark, sf):
    ev = TB.table(spark, sf, "events").select("ts")
    got = TB.dummy_model_data(ev, "ts", 3, 1)
    row = got.agg(F.count("*").alias("n"), F.max("x").alias("x"), F.min("ts").alias("lo"),
                  F.max("target").alias("t")).first()
    assert row.n == 1000 and row.x == pytest.approx(25.1327, abs=1e-3) and row.t == 2
    assert row.lo == ev.agg(F.max("ts")).first()[0]
