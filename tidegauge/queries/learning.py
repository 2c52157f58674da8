"""ML: text classification, other models and quality measures."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidegauge.functions.hashing import sql_unit_hash
from tidegauge.functions.labels import map_values
from tidegauge.operators import model as M
from tidegauge.operators.text import tf_idf
from tidegauge.plans import sentiment
from tidegauge.queries import query
from tidegauge.queries.sources import scratch
from tidegauge.sources.artifacts import load_model, save_model
from tidegauge.sources.tables import table

LANGS = ["de", "en", "es", "fr"]
LANG_ID = {name: i for i, name in enumerate(LANGS)}


def documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", "text", "lang", map_values("lang", LANG_ID).alias("target"))


def language_model(spark, folder):
    return M.fit_text_classifier(documents(spark, folder), "text", "target")


@query("ml01_train_test_split", f"""SELECT doc_id,
  CASE WHEN {sql_unit_hash('doc_id', seed=42)} < 0.25 THEN 'test' ELSE 'train' END AS part FROM documents""")
def split(spark, folder):
    return M.split_by_hash(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 0.25)


@query("ml02_tf_idf", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text),
  '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 2000),
w AS (SELECT c.doc_id, c.term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w
  FROM c JOIN v ON v.term = c.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""")
def tfidf(spark, folder):
    out = tf_idf(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.withColumn("tfidf", F.round("tfidf", 6))


SQL_TERMS = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
v AS (SELECT term, count(*) AS total FROM t GROUP BY 1 ORDER BY total DESC, term LIMIT 2000),
k AS (SELECT doc_id, count(DISTINCT t.term) AS terms FROM t JOIN v ON v.term = t.term GROUP BY 1)"""


@query("ml02_tf_idf_vectors", f"""WITH {SQL_TERMS} SELECT d.doc_id, CASE WHEN terms > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS n2,
  coalesce(terms, 0)::INTEGER AS terms FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def tfidf_vectors(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors = M.fit_vectoriser(docs, "text").transform(docs)
    a = vector_to_array("features")
    length = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("doc_id", F.round(length, 6).alias("n2"),
                          F.size(F.filter(a, lambda x: x != 0)).alias("terms"))


@query("ml03_logistic_regression")
def logistic(spark, folder):
    docs = documents(spark, folder)
    scored = M.predict(language_model(spark, folder), docs, LANGS)
    return scored.select("doc_id", "lang", "label")


SQL_PRED = """p AS (SELECT d.doc_id, quality AS y, (n_chars > 500)::INTEGER AS p
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def rule_predictions(spark, folder):
    """A prediction table from a simple rule on labelled documents."""
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 500).cast("int").alias("p"))


@query("ml03_mean_probability", """SELECT lang, round(count(*) / (SELECT count(*) FROM documents), 3) AS share
FROM documents GROUP BY 1""")
def mean_probability(spark, folder):
    """With a free intercept the mean predicted probability of a class is its share."""
    docs = documents(spark, folder)
    scored = M.predict(language_model(spark, folder), docs, LANGS)
    means = scored.agg(*(F.avg(F.get("scores", F.lit(i))).alias(c) for i, c in enumerate(LANGS)))
    return means.unpivot([], LANGS, "lang", "share").withColumn("share", F.round("share", 3))


@query("ml04_accuracy", f"WITH {SQL_PRED} SELECT round(avg((y = p)::INTEGER), 6) AS accuracy FROM p")
def accuracy(spark, folder):
    return M.accuracy(rule_predictions(spark, folder), "y", "p").select(
        F.round("accuracy", 6).alias("accuracy"))


@query("ml04_model_accuracy")
def model_accuracy(spark, folder):
    _, acc = sentiment.train(documents(spark, folder), "doc_id", "text", "target")
    return acc


@query("ml05_roc_auc_ovo", """WITH s AS (SELECT vec_id, label AS y, unnest(generate_series(0, 9)) AS k,
  unnest(embedding[1:10])::DOUBLE AS s FROM embeddings),
r AS (SELECT k AS a, b.b, s, (y = k)::INTEGER AS pos FROM s, (SELECT unnest(generate_series(0, 9)) AS b) b
  WHERE b.b <> k AND (y = k OR y = b.b)),
c AS (SELECT a, b, s, sum(pos) AS pos, sum(1 - pos) AS neg FROM r GROUP BY 1, 2, 3),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY a, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS below FROM c),
o AS (SELECT a, b, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM u GROUP BY 1, 2)
SELECT round(avg(auc), 6) AS roc_auc_ovo FROM o""")
def auc(spark, folder):
    e = table(spark, folder, "embeddings").select(
        "label", F.slice("embedding", 1, 10).alias("scores"))
    return M.roc_auc_ovo(e, "label", "scores", list(range(10))).select(
        F.round("roc_auc_ovo", 6).alias("roc_auc_ovo"))


@query("ml05_model_roc_auc")
def model_auc(spark, folder):
    docs = documents(spark, folder)
    return sentiment.auc(language_model(spark, folder), docs, "target", list(range(4)))


SQL_LANG = """p AS (SELECT lang AS y, CASE n_chars % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es'
  ELSE 'fr' END AS p FROM documents)"""


def language_guesses(spark, folder):
    n = (F.col("n_chars") % 4).cast("int")
    return table(spark, folder, "documents").select(
        F.col("lang").alias("y"), map_values(n, dict(enumerate(LANGS))).alias("p"))


@query("ml06_confusion_matrix", f"WITH {SQL_LANG} SELECT y, " + ", ".join(
    f"round((count(*) FILTER (p = '{c}')) / count(*), 6) AS p_{c}" for c in LANGS) +
    " FROM p GROUP BY 1")
def confusion(spark, folder):
    out = M.confusion_matrix(language_guesses(spark, folder), "y", "p", LANGS)
    return out.withColumns({f"p_{c}": F.round(f"p_{c}", 6) for c in LANGS})


@query("ml07_classification_report", f"""WITH {SQL_LANG},
c AS (SELECT c AS class, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (p = c) AS pp,
  count(*) FILTER (y = c) AS n FROM p, (VALUES ('de'), ('en'), ('es'), ('fr')) AS k(c) GROUP BY 1),
r AS (SELECT class, coalesce(tp / nullif(pp, 0), 0)::DOUBLE AS precision,
  coalesce(tp / nullif(n, 0), 0)::DOUBLE AS recall, n AS support FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r),
u AS (SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), sum(support)::BIGINT, avg(f1)
  FROM f UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(support)::BIGINT, sum(f1 * support) / sum(support) FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, support::BIGINT AS support,
  round(f1, 6) AS f1 FROM u""")
def report(spark, folder):
    out = M.classification_report(language_guesses(spark, folder), "y", "p", LANGS)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("ml08_predict_text")
def predict(spark, folder):
    posts = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return M.predict(language_model(spark, folder), posts, LANGS).select(
        "conv_id", "turn", "label")


@query("ml08_predicts_separable_texts", """SELECT event_type AS label, count(*) AS texts, 0::BIGINT AS wrong
FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def predict_separable(spark, folder):
    """Every event written as a text of its type's word among common ones: each gets its own label."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    noise = F.concat_ws(" ", F.lit("the event was"), F.concat(F.lit("n"), F.col("event_id") % 13))
    events = table(spark, folder, "events").where("event_type IS NOT NULL").select(
        "event_id", "event_type", F.concat_ws(" ", noise, "event_type").alias("text"),
        (F.array_position(F.lit(kinds), F.col("event_type")) - 1).cast("int").alias("target"))
    model = M.fit_text_classifier(events, "text", "target", c=100.0, max_iter=100)
    found = M.predict(model, events, kinds)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("texts"),
                                      F.count_if(F.col("label") != F.col("event_type")).alias("wrong"))


@query("ml09_words_above_the_quantile", f"""WITH {SQL_TERMS}, n AS (SELECT count(*) AS n FROM v)
SELECT c::INTEGER AS class, (n - 1 - floor(0.99::DOUBLE * (n - 1)))::BIGINT AS words FROM n, range({len(LANGS)}) t(c)""")
def words_above(spark, folder):
    """As many words of a class lie above its quantile as the size of the vocabulary says."""
    return M.strongest_words(language_model(spark, folder)).groupBy("class").agg(F.count(F.lit(1)).alias("words"))


@query("ml09_strongest_words")
def words(spark, folder):
    return M.strongest_words(language_model(spark, folder)).withColumn(
        "weight", F.round("weight", 4))


def vectors(spark, folder):
    from pyspark.ml.functions import array_to_vector
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>"))
        .alias("features"))


@query("ml10_dense_classifier")
def dense(spark, folder):
    data = vectors(spark, folder)
    model = M.fit_dense_classifier(data, "label", [64, 16, 10], 40)
    return model.transform(data).select("vec_id", "label", F.col("prediction").cast("int")
                                        .alias("predicted"))


@query("ml10_dense_classifier_separates", """SELECT count(*) AS n, true AS accurate, true AS better FROM lineitem""")
def dense_separates(spark, folder):
    """A class bounded on both sides: the net gets 95 of 100 right, which no single threshold does."""
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_quantity") / 50).alias("a"), ((F.col("l_quantity") > 15) & (F.col("l_quantity") <= 35)).cast("int").alias("label"))
    data = M.feature_vector(rows, ["a"])
    found = M.fit_dense_classifier(data, "label", [1, 6, 2], 100).transform(data)
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    threshold = F.greatest(*(F.avg(((F.col("a") > cut / 50) == (F.col("label") == 1)).cast("double")) for cut in (0, 15, 35, 50)))
    return found.agg(F.count(F.lit(1)).alias("n"), (right >= 0.95).alias("accurate"), (right > threshold).alias("better"))


@query("ml11_linear_regression", """SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""")
def linear(spark, folder):
    data = M.feature_vector(table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice"),
                            ["l_quantity"])
    model = M.fit_linear(data, "l_extendedprice")
    row = [(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))]
    return spark.createDataFrame(row, "slope double, intercept double")


def _boosting_rows(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_extendedprice")
    tagged = M.split_by_hash(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 0.25)
    return M.feature_vector(tagged.withColumn("held_out", F.col("part") == "test"),
                            ["l_quantity", "l_discount", "l_tax"])


@query("ml11_boosted_regression")
def boosted(spark, folder):
    data = _boosting_rows(spark, folder)
    model = M.fit_boosted(data.where("NOT held_out"), "l_extendedprice", rounds=5)
    from tidegauge.operators.stats import regression_metrics
    scored = model.transform(data).select("part", "l_extendedprice", "prediction")
    return regression_metrics(scored, "l_extendedprice", "prediction", ["part"])


@query("ml12_early_stopping")
def early_stop(spark, folder):
    data = _boosting_rows(spark, folder)
    model = M.fit_boosted(data, "l_extendedprice", "held_out", rounds=10, tolerance=0.05)
    scored = model.transform(data).withColumn("trees", F.lit(model.getNumTrees))
    return scored.groupBy("part").agg(F.max("trees").alias("trees"), F.sqrt(F.avg(
        F.pow(F.col("prediction") - F.col("l_extendedprice"), 2))).alias("rmse"))


@query("ml12_stops_before_the_last_round", """SELECT 12::INTEGER AS rounds, true AS stopped""")
def stops_early(spark, folder):
    """Prices that follow from nothing the trees see: the held-out loss does not fall, and rounds end."""
    data = _boosting_rows(spark, folder).withColumn("noise", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1000)).cast("double"))
    model = M.fit_boosted(data, "noise", "held_out", rounds=12)
    return spark.range(1).select(F.lit(12).alias("rounds"), F.lit(model.getNumTrees < 12).alias("stopped"))


@query("ml13_codes_are_uncorrelated", """SELECT count(*) AS n, 0.0::DOUBLE AS covariance, true AS ordered FROM embeddings""")
def uncorrelated(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    # codes that vary, the first more than the second
    spread = (F.var_pop("x") >= F.var_pop("y")) & (F.var_pop("y") > 1e-9)
    return M.encode_2d(e, "embedding").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.round(F.covar_pop("x", "y"), 6)).alias("covariance"), spread.alias("ordered"))


@query("ml13_encode_2d")
def encode(spark, folder):
    return M.encode_2d(table(spark, folder, "embeddings").select("vec_id", "embedding"),
                       "embedding").select("vec_id", F.round("x", 6).alias("x"),
                                           F.round("y", 6).alias("y"))


@query("ml14_save_load_model", f"""WITH {SQL_TERMS} SELECT d.doc_id, coalesce(terms, 0)::INTEGER AS terms
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def save_load(spark, folder):
    root = scratch(spark, "registry")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    save_model(M.fit_vectoriser(docs, "text"), root, "sentiment_analysis_vectorizer", "Staging")
    loaded = load_model(root, "sentiment_analysis_vectorizer", "Staging")
    return loaded.transform(docs).select(
        "doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x != 0)).alias("terms"))


@query("ml15_promotion_gate", """WITH m AS (SELECT round(regr_r2(l_extendedprice, l_tax), 6) AS baseline,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS candidate FROM lineitem)
SELECT baseline, candidate, candidate >= 0.5 AND candidate - baseline >= 0.05
  AND candidate - baseline >= 0.05 * abs(baseline) AS accepted FROM m""")
def gate(spark, folder):
    li = table(spark, folder, "lineitem")
    r2 = li.agg(F.round(F.regr_r2("l_extendedprice", "l_tax"), 6).alias("baseline"),
                F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("candidate"))
    metrics = r2.unpivot([], ["baseline", "candidate"], "run_id", "value").withColumn(
        "name", F.lit("r2"))
    return M.promotion_gate(metrics, "baseline", "candidate")
