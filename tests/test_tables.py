"""Small golden cases, positions and quantiles against pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import encode, scalars
from tidegauge.functions.labels import class_label, sentiment_class, sentiment_sign
from tidegauge.functions.text import character_vocabulary, characters, decode_characters, encode_characters, tokens
from tidegauge.operators import (
    aggregate, align, missing, order, position, project, quantiles, timeseries,
)

FEW = settings(max_examples=8, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame(
        [(1.0, 5.0, 10), (2.0, None, 20), (None, None, 30), (4.0, 8.0, 40)],
        "a double, b double, c int")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_missing(holes):
    counts = {r.column_name: (r.nulls, r.null_pct) for r in missing.null_counts(holes).collect()}
    assert counts == {"a": (1, 25.0), "b": (2, 50.0), "c": (0, 0.0)}
    assert missing.drop_null_columns(holes).columns == ["c"]
    assert [r.b for r in missing.fill_mean(holes, ["a", "b"]).orderBy("c").collect()] == [
        5.0, 6.5, 6.5, 8.0]


def test_null_counts_of_empty_table(holes):
    out = missing.null_counts(holes.where("c > 99")).collect()
    assert all(r.nulls == 0 and r.null_pct is None for r in out)


def test_group_mean_fill(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("y", None), (None, None)],
                               "k string, v double")
    got = missing.fill_group_mean(df, "v", "k").collect()
    assert sorted((r.k or "", r.v) for r in got if r.v is not None) == [("x", 1.0), ("x", 1.0)]
    assert len(got) == 4


def test_aligned_addition(spark):
    a = spark.createDataFrame([("USA", 250), ("China", 450), ("India", 200), ("Brazil", 150)],
                              "k string, v int")
    b = spark.createDataFrame([("USA", 260), ("China", 500), ("India", 210), ("Japan", 100)],
                              "k string, v int")
    out = align.aligned(a, b, ["k"], "v", "v", lambda x, y: x + y, "t")
    assert rows(out, "k") == [("Brazil", None), ("China", 950), ("India", 410), ("Japan", None),
                              ("USA", 510)]
    filled = align.aligned(a, b, ["k"], "v", "v", lambda x, y: x + y, "t", fill=0)
    assert dict(rows(filled, "k"))["Japan"] == 100


def test_concat_columns(spark):
    a = spark.createDataFrame([(100 * i, 11 + i) for i in range(1, 6)], "A int, B int")
    b = spark.createDataFrame([(i, p) for i, p in enumerate([0, 1, 1, 0])], "i int, pred int")
    got = align.concat_columns(a, b, ["A"], ["i"]).orderBy("row_no").collect()
    assert [r.pred for r in got] == [0, 1, 1, 0, None]
    assert [r.A for r in got] == [100, 200, 300, 400, 500]


def test_population_moments(spark):
    m = aggregate.moments("id")
    r = spark.range(10).agg(m["var_pop"].alias("v"), m["std_pop"].alias("s")).first()
    assert r.v == 8.25 and r.s == pytest.approx(2.8722813232690143, abs=1e-14)


def test_unbiased_moments_match_pandas(spark):
    x = pd.Series([1.0, 2.0, 2.5, 4.0, 8.0, 9.0, 1.5, 3.0])
    m = aggregate.moments("x")
    r = spark.createDataFrame(x.to_frame("x")).agg(*[m[k].alias(k) for k in m]).first()
    assert r["skew"] == pytest.approx(x.skew()) and r["kurt"] == pytest.approx(x.kurt())
    assert r["sem"] == pytest.approx(x.sem()) and r["std"] == pytest.approx(x.std())


def test_moments_of_two_rows_are_null_not_an_error(spark):
    m = aggregate.moments("id")
    r = spark.range(2).agg(m["skew"].alias("a"), m["kurt"].alias("b")).first()
    assert r.a is None and r.b is None


def test_value_counts_unique_duplicates(spark):
    df = spark.createDataFrame(list(zip("AABBCC", [100, 200, 300, 300, 400, 500],
                                        ["NY", "CA", "WA", "WA", "AK", "NV"])),
                               "k1 string, col1 int, col2 string")
    assert rows(aggregate.value_counts(df, "col2"), F.desc("cnt"), "col2")[0] == ("WA", 2)
    assert df.dropDuplicates().count() == 5
    assert aggregate.mode(df, "col1").first().mode == 300
    assert aggregate.extreme_keys(df, "col1", "k1").first() == ("A", "C")


def test_extreme_key_ties_take_the_first(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0), (4, 5.0)], "k int, v double")
    assert tuple(aggregate.extreme_keys(df, "v", "k").first()) == (1, 2)


def test_extreme_keys_pass_over_missing_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0), ("b", 4, nan), ("b", 5, None),
                                ("c", 6, nan), ("c", 7, -1.0), (None, 8, 2.0)], "g string, k int, v double")
    got = {r.g: (r.idxmin, r.idxmax) for r in aggregate.extreme_keys(df, "v", "k", ["g"]).collect()}
    assert got == {"a": (2, 3), "b": (None, None), "c": (7, 7), None: (8, 8)}
    low, high = -2 ** 63, 2 ** 63 - 1  # the smallest integer has no negative
    ints = spark.createDataFrame([("x", low), ("y", low), ("z", high), ("w", high), ("v", None)], "k string, v long")
    assert tuple(aggregate.extreme_keys(ints, "v", "k").first()) == ("x", "w")
    for kind, least, most in (("string", "'a'", "'c'"), ("date", "date'1900-01-01'", "date'2024-01-01'"),
                              ("timestamp", "timestamp'1900-01-01 00:00:00'", "timestamp'2024-01-01 00:00:00'"),
                              ("decimal(10,2)", "-1.5", "2.5"), ("boolean", "false", "true")):
        rows = spark.sql(f"""SELECT g, k, CAST(v AS {kind}) AS v FROM VALUES ('p', 1, null), ('p', 4, {most}), ('p', 3, {most}),
            ('p', 9, {least}), ('p', 2, {least}), ('q', 5, null), (null, 6, {least}), (null, 7, null) AS t(g, k, v)""")
        got = {r.g: (r.idxmin, r.idxmax) for r in aggregate.extreme_keys(rows, "v", "k", ["g"]).collect()}
        assert got == {"p": (2, 3), "q": (None, None), None: (6, 6)}, kind
        assert tuple(aggregate.extreme_keys(rows, "v", "k").first()) == (2, 3), kind
    assert tuple(aggregate.extreme_keys(ints.limit(0), "v", "k").first()) == (None, None)


def test_daily_pivot_spans(spark):
    df = spark.createDataFrame(
        [("2024-01-01 05:00:00", "neg"), ("2024-01-03 05:00:00", "neg"),
         ("2024-01-02 01:00:00", "pos")], "t string, s string").selectExpr(
        "cast(t as timestamp_ntz) ts", "s")
    got = aggregate.daily_class_pivot(df, "ts", "s", ["neg", "pos"]).orderBy("day").collect()
    assert [(r.neg, r.pos, r.total) for r in got] == [(1, None, 1), (0, 1, 1), (1, None, 1)]


@pytest.mark.parametrize("head,n_head,n_tail,want", [
    (True, 3, None, [0, 1, 2]), (False, 3, None, list(range(3, 10))),
    (True, None, 3, list(range(7))), (False, None, 3, [7, 8, 9]),
    (True, 0, None, []), (False, 0, None, list(range(10))), (True, 99, None, list(range(10))),
    (False, 99, None, []), (True, None, 0, list(range(10))), (False, None, 99, list(range(10)))])
def test_filter_data(spark, head, n_head, n_tail, want):
    got = position.filter_data(spark.range(10), ["id"], head, n_head, n_tail)
    assert [r.id for r in got.orderBy("id").collect()] == want


def test_null_keys_come_first_in_slices_and_last_in_values(spark):
    df = spark.range(20).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("k"))
    want = [r.id for r in df.orderBy("k", "id").collect()]
    for a, b in ((0, 3), (2, 9), (None, -4), (-4, None), (5, 99), (None, None)):
        assert {r.id for r in position.slice_rows(df, ["k", "id"], a, b).collect()} == set(want[a:b])
    by_value = [r.id for r in df.orderBy(F.desc("k"), "id").collect()]
    for share in (0, 0.1, 0.8, 1.0):
        got = {r.id for r in position.skip_top_share(df, "k", "id", share).collect()}
        assert got == set(by_value[int(share * 20):])


def test_filter_data_needs_exactly_one_size(spark):
    for args in ((None, None), (1, 1)):
        with pytest.raises(ValueError):
            position.filter_data(spark.range(3), ["id"], True, *args)


def test_positions_with_a_hot_tie(spark):
    """A third of the rows share one sort value; every position appears exactly once."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(
        F.col("id") % 50).alias("v"))
    got = position.with_position(df, ["v", "id"]).toPandas().sort_values("pos")
    assert got.pos.tolist() == list(range(3000))
    assert got[["v", "id"]].equals(got[["v", "id"]].sort_values(["v", "id"]))


def test_positions_within_hot_and_null_keys(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("k"))
    got = position.with_position(df, ["id"], "pos", keys=["k"]).toPandas()
    want = got.sort_values("id").groupby("k", dropna=False).cumcount()
    assert got.sort_values("id").pos.tolist() == want.tolist()


def test_slice_and_split(spark):
    df = spark.range(100)
    assert sorted(r.id for r in position.slice_rows(df, ["id"], -5).collect()) == list(range(95, 100))
    parts = position.split_by_share(df, ["id"], 0.73).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 73, "test": 27}


@FEW
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.floats(0, 1))
def test_exact_quantile(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = quantiles.exact_quantiles(df, "v", [q]).first().value
    assert got == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_exact_quantiles_per_skewed_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.34, -1, rng.integers(0, 9, 4000)),
                        "v": np.round(rng.exponential(100, 4000), 1)})
    pdf.loc[pdf.k == 3, "v"] = 5.0
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), "v", [0.0, 0.25, 0.5, 0.99, 1.0],
                                    ["k"]).toPandas().set_index(["k", "q"]).value
    for k, part in pdf.groupby("k"):
        for q in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert got[(k, q)] == pytest.approx(np.quantile(part.v, q), abs=1e-9)


@pytest.mark.parametrize("ties", [False, True])
def test_ranks_inside_narrow_brackets(spark, monkeypatch, ties):
    """With a coarse sketch a few thousand rows are a large group; only rows near a rank are moved."""
    monkeypatch.setattr(quantiles, "ACCURACY", 500)
    monkeypatch.setattr(quantiles, "NARROW", 8 / 500)
    monkeypatch.setattr(quantiles, "LARGE", 125)
    monkeypatch.setattr(quantiles, "SMALL", 50)
    monkeypatch.setattr(quantiles, "WIDE", 0.1)
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "warm", "cold"], 9000, p=[0.97, 0.02, 0.01]), "v": rng.normal(size=9000)})
    if ties:
        pdf["v"] = np.where(rng.random(9000) < 0.4, 0.25, np.round(pdf.v, 1))
    qs = [0.0, 0.01, 0.25, 0.27, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(pdf).repartition(7)
    got = quantiles.exact_quantiles(df, "v", qs, ["k"]).toPandas().set_index(["k", "q"]).value
    for k, part in pdf.groupby("k"):
        for q in qs:
            assert got[(k, q)] == pytest.approx(np.quantile(part.v, q), abs=1e-12)
    whole = quantiles.exact_quantiles(df, "v", qs).toPandas().set_index("q").value
    assert all(whole[q] == pytest.approx(np.quantile(pdf.v, q), abs=1e-12) for q in qs)


def test_quantiles_move_only_rows_near_their_rank(spark):
    """Of a group above LARGE rows fewer than a hundredth go through an exchange."""
    df = spark.range(0, 200_000, 1, 8).select(F.rand(3).alias("v"))
    facts = df.agg(quantiles.sketch(F.col("v"), [0.5]).alias("_f")).first()[0]
    low, high = facts["at"][1], facts["at"][2]
    assert facts["total"] >= quantiles.LARGE
    assert 0 < df.where((F.col("v") >= low) & (F.col("v") <= high)).count() < 2000
    got = quantiles.exact_quantiles(df, "v", [0.5]).first().value
    assert got == pytest.approx(np.quantile([r.v for r in df.collect()], 0.5), abs=1e-15)
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_totals_below(spark):
    pdf = pd.DataFrame({"v": np.arange(500) % 77, "n": 1})
    counted = pdf.groupby("v", as_index=False).n.sum()
    got = quantiles.totals_below(spark.createDataFrame(counted), "v", ["n"]).toPandas()
    want = counted.n.cumsum() - counted.n
    assert got.sort_values("v").n_below.tolist() == want.tolist()


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 4.0, 8.0, None], "y": [3.0, 3.0, 3.0, 3.0, 3.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, y double")
    got = quantiles.describe(df, ["x", "y"]).toPandas().set_index("column_name")
    want = pdf.describe().T
    assert np.allclose(got[["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float),
                       want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]])


def test_box_summary_of_constant_column(spark):
    r = quantiles.box_summary(spark.range(5).select(F.lit(2.0).alias("v")), "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2, 2, 2, 2, 2, 0)


def test_histogram_counts_every_row_once(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 5, 9.99, 10]], "v double")
    got = aggregate.histogram(df, "v", 10).orderBy("bin").collect()
    assert sum(r.cnt for r in got) == 6 and len(got) == 10 and got[9].cnt == 2
    constant = aggregate.histogram(spark.range(4).select(F.lit(1.0).alias("v")), "v", 3).collect()
    assert sum(r.cnt for r in constant) == 4


def test_labels(spark):
    df = spark.createDataFrame([("positive",), ("neutral",), ("negative",), ("other",), (None,)],
                               "s string")
    got = [(r.a, r.b, r.c) for r in df.select(
        sentiment_sign("s").alias("a"), sentiment_class("s").alias("b"),
        class_label(sentiment_class("s")).alias("c")).collect()]
    assert got == [(1, 1, "positive"), (0, 2, "neutral"), (-1, 0, "negative"),
                   (None, None, None), (None, None, None)]


def test_division_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(scalars.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and np.isnan(got[2]) and got[3] == 2.0


def test_bad_text_becomes_null(spark):
    df = spark.createDataFrame([("12ab",), ("ab",), (None,)], "s string")
    got = df.select(scalars.prefix_int("s", 2).alias("p"), missing.parse_time("s").alias("t")).collect()
    assert [r.p for r in got] == [12, None, None] and all(r.t is None for r in got)


def test_tokens_need_two_word_characters(spark):
    df = spark.createDataFrame([("A über-cool I_D x2 !",)], "t string")
    assert df.select(tokens("t")).first()[0] == ["über", "cool", "i_d", "x2"]


def test_dummies(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "c string, v int")
    assert encode.dummies(df, "c", ["a", "b"]).columns == ["v", "c_a", "c_b"]
    assert encode.dummies(df, "c", ["a", "b"], drop_first=True).columns == ["v", "c_b"]
    assert encode.one_hot_long(df, "v", "c").count() == 2


def test_transpose_and_order(spark):
    df = spark.createDataFrame([("r1", 1.0, 2.0), ("r2", 3.0, 4.0)], "k string, a double, b double")
    assert rows(project.transpose(df, "k", ["a", "b"], ["r1", "r2"]), "column_name") == [
        ("a", 1.0, 3.0), ("b", 2.0, 4.0)]
    ranked = order.category_order(df, "k", ["r2", "r1"])
    assert [r.k for r in ranked.collect()] == ["r2", "r1"]


def test_seeded_shuffle_is_a_stable_permutation(spark):
    df = spark.range(200)
    a = [r.id for r in order.shuffle_rows(df, ["id"], 1).collect()]
    b = [r.id for r in order.shuffle_rows(df.repartition(5), ["id"], 1).collect()]
    assert a == b != list(range(200)) and sorted(a) == list(range(200))


def test_chunks_drop_the_remainder(spark):
    df = spark.range(10).select(F.lit("d").alias("k"), F.col("id").alias("pos"),
                                F.col("id").cast("string").alias("item"))
    got = timeseries.input_target(timeseries.chunk_sequences(df, ["k"], "pos", "item", 4))
    assert [(r.chunk, r.input, r.target) for r in got.orderBy("chunk").collect()] == [
        (0, ["0", "1", "2"], ["1", "2", "3"]), (1, ["4", "5", "6"], ["5", "6", "7"])]


def test_sample_is_reproducible_across_layouts(spark):
    df = spark.range(5000)
    a = aggregate.sample_rows(df, ["id"], 0.1, 3).orderBy("id").collect()
    b = aggregate.sample_rows(df.repartition(3), ["id"], 0.1, 3).orderBy("id").collect()
    assert a == b and 400 < len(a) < 600
    assert aggregate.sample_rows(df, ["id"], 1.0).count() == 5000


def test_characters_there_and_back(spark):
    texts = ["abba", "\u00e9\U0001F600\uffff\n a", "", None, "a" * 3000, "a\x00\u0430b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vocab = character_vocabulary(df, "text")
    assert [r.ch for r in vocab.orderBy("code").collect()] == sorted({c for t in texts for c in t or ""})
    coded = encode_characters(characters(df, "id", "text"), vocab)
    code = {r.ch: r.code for r in vocab.collect()}
    full = {i: t for i, t in enumerate(texts) if t}
    assert {r.id: list(r.codes) for r in coded.collect()} == {i: [code[c] for c in t] for i, t in full.items()}
    back = decode_characters(coded.select("id", "codes"), vocab)
    assert {r.id: "".join(r.chars) for r in back.collect()} == full
    # codes with holes, and characters without one
    some = spark.createDataFrame([("b", 70), ("a", 3)], "ch string, code int")
    coded = encode_characters(characters(df.where("id = 0 OR id = 5"), "id", "text"), some)
    assert {r.id: r.codes for r in coded.collect()} == {0: [3, 70, 70, 3], 5: [3, None, None, 70]}
    assert {r.id: r.chars for r in decode_characters(coded, some).collect()} == {
        0: list("abba"), 5: ["a", None, None, "b"]}


def test_decoded_texts_that_share_an_id(spark, tmp_path):
    """Their characters are merged in order of position, as when every character was a row."""
    from tidegauge.queries.scalars import decode_chars
    rows = [(1, "bcd"), (1, "ax"), (2, "one"), (None, "n"), (None, "m"), (3, ""), (4, None)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in decode_chars(spark, str(tmp_path)).collect()}
    assert got == {1: "abcxd", 2: "one", None: "mn"}


def test_quantiles_of_many_groups_with_a_null_key(spark):
    """Too many groups to bring to the rows: the rows are joined by an exchange, with the same result."""
    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 6007).alias("v"))
    def found():
        box = {r.k: tuple(r)[1:] for r in quantiles.box_summary(df, "v", ["k"]).collect()}
        return box, {(r.k, r.column_name): tuple(r)[2:] for r in quantiles.describe(df, ["v"], ["k"]).collect()}
    few = found()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found() == few and None in few[0] and len(few[0]) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pdf = df.toPandas()
    part = pdf[pdf.k == 1].v
    assert few[0][1][:3] == tuple(np.quantile(part, q) for q in (0.25, 0.5, 0.75))
