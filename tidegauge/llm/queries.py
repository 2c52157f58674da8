"""Registered queries of this subpackage: thin bindings, digests and the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import (byte_bpe, chat, cotraining, fingerprint, infill, language, mixing, pii, ranked, rules,
                           simhash, suffixes, toxicity)
from tidegauge.llm.common import read, small_batches
from tidegauge.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(configure(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_fingerprints(spark, sf_dir):
    found = fingerprint.compare(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        fingerprint.as_string(F.col("choice")).alias("fingerprint"),
                        fingerprint.as_string(F.col("edited_choice")).alias("edited_fingerprint"),
                        "near_edited", "near_next")


@query
def op2_cotraining(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, read(spark, sf_dir, "labels")))


@query
def op3_risk_rules(spark, sf_dir):
    found = rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept",
                        F.concat_ws(",", "rejected_by").alias("rejected_by"))


SQL["op3_risk_rules"] = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM r)),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' ||
    lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS gram
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
tw AS (SELECT rid, gram FROM g WHERE gram IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
h AS (SELECT g.rid, max(tw.rid IS NOT NULL) OVER (PARTITION BY g.rid ORDER BY i ROWS 7 PRECEDING) AS again
  FROM g LEFT JOIN tw ON tw.rid = g.rid AND tw.gram = g.gram),
c AS (SELECT rid, count(*) AS n_words, count_if(again) AS n_repeat_words FROM h GROUP BY 1),
b AS (SELECT r.rid, doc_id, lang, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper,
    len(regexp_extract_all(t, '[!?]')) AS n_marks, list_filter(string_split(t, chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM r LEFT JOIN c ON c.rid = r.rid),
f AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM b),
s AS (SELECT rid, doc_id, lang, base_failed, unnest([1, 2, 3, 4, 5]) AS no,
    unnest(['symbols', 'upper', 'marks', 'dup_lines', 'repeats']) AS rule,
    unnest([coalesce(n_symbols / nullif(word_chars, 0), 0.0::DOUBLE), coalesce(n_upper / nullif(word_chars, 0), 0.0::DOUBLE),
      least(coalesce(n_marks / nullif(n_words, 0), 0.0::DOUBLE), 1.0::DOUBLE),
      coalesce(n_dup_lines / nullif(n_lines, 0), 0.0::DOUBLE), coalesce(n_repeat_words / nullif(n_words, 0), 0.0::DOUBLE)]) AS signal
  FROM f),
m AS (SELECT s.*, quality FROM s JOIN labels l ON l.doc_id = s.doc_id WHERE NOT base_failed AND quality IN (0, 1)),
k AS (SELECT lang, rule, cut, count_if(quality = 1) AS n, count_if(quality = 1 AND signal > cut) AS lost,
    count_if(quality = 0 AND signal > cut) AS caught
  FROM m, (SELECT i / 50.0::DOUBLE AS cut FROM range(50) t(i)) GROUP BY ALL),
p AS (SELECT *, 0.05::DOUBLE / 5 AS p, 0.05::DOUBLE / (5 * (SELECT greatest(1, count(*)) FROM (SELECT DISTINCT lang FROM m))) AS d FROM k),
q AS (SELECT *, CASE WHEN lost >= n * p THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, (lost + 1)::BIGINT), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) END > d AS fails FROM p),
z AS (SELECT *, max(CASE WHEN fails THEN cut END) OVER (PARTITION BY lang, rule) AS floor FROM q),
o AS (SELECT lang, rule, max_by(cut, (caught - 10 * lost, cut)) AS cut FROM z
  WHERE (floor IS NULL OR cut > floor) AND caught > 10 * lost GROUP BY 1, 2),
j AS (SELECT s.rid, coalesce(string_agg(s.rule, ',' ORDER BY no) FILTER (signal > cut), '') AS rejected_by
  FROM s LEFT JOIN o ON o.lang IS NOT DISTINCT FROM s.lang AND o.rule = s.rule GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM f JOIN j ON j.rid = f.rid"""


@query
def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op5_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_pii(spark, sf_dir):
    return pii.span_digests(read(spark, sf_dir, "documents"))


@query
def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_digests(read(spark, sf_dir, "documents"))


@query
def op8_chat(spark, sf_dir):
    told = spark.sql(r"""SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(told)
    found = chat.read_back(chat.format_trees(chat.from_turns(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                        F.sha2("loss_text", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


SQL["op8_chat"] = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 14 + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')))::BIGINT
    AS formatted_chars
FROM r GROUP BY conv_id"""


@query
def op9_mixing(spark, sf_dir):
    taken = mixing.mix(read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL["op9_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(text) AS chars,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / coalesce(1.0::DOUBLE / (1.0 + abs(chars::DOUBLE / nullif(size, 0) - 6.0)
    / 6.0), 1.0::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level * w <= cap
    ORDER BY cap / w, source NULLS LAST LIMIT 1)) AS target FROM l),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
r AS (SELECT *, target - epochs * source_size AS rest FROM e)
SELECT k.doc_id, k.size::BIGINT AS size, r.source_size, r.target,
  (k.size * (r.epochs + CASE WHEN r.rest > 0 AND sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id
    ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE <= r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source"""


@query
def op10_suffixes(spark, sf_dir):
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"))


def _hash_steps(*by: int) -> str:
    """Hashes of longer and longer windows, each from two of the one before, ``by`` words apart."""
    return "".join(f"""
h{k + 1} AS (SELECT * REPLACE (hash(h, lead(h, {n}) OVER (PARTITION BY tid ORDER BY i)) AS h) FROM h{k}),"""
                   for k, n in enumerate(by))


SQL["op10_suffixes"] = rf"""
WITH x AS (SELECT row_number() OVER () AS tid, t, n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY 1)),
u AS (SELECT tid, n, len(ws) AS nw, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM x WHERE len(ws) >= 50),
h0 AS (SELECT tid, n, nw, i, hash(w) AS h FROM u),{_hash_steps(1, 2, 4, 8, 16, 18)}
w AS (SELECT tid, n, i, h FROM h6 WHERE i <= nw - 50),
tw AS (SELECT h FROM w GROUP BY 1 HAVING min(tid) <> max(tid)),
s AS (SELECT tid, i, i - lag(i) OVER (PARTITION BY tid ORDER BY i) AS gap FROM w JOIN tw ON tw.h = w.h WHERE n = 1),
p AS (SELECT tid, i, sum(CASE WHEN gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM s),
q AS (SELECT tid, min(i) AS a, max(i) + 50 AS b FROM p GROUP BY tid, part
  UNION ALL SELECT tid, 0, len(ws) FROM x WHERE n > 1 AND len(ws) >= 50)
SELECT doc_id, a::INTEGER AS start, b::INTEGER AS "end" FROM documents d JOIN x ON x.t = coalesce(d.text, '')
JOIN q ON q.tid = x.tid"""


@query
def op11_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op12_fill_in_middle(spark, sf_dir):
    found = infill.transform(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


SQL["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, ('0x' || h[1:8])::BIGINT AS h1,
    ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a,
    greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m,
    array_to_string(ls[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


@query
def op13_ranked_search(spark, sf_dir):
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL["op13_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
  FROM benchmark),
s AS (SELECT count(*) AS nd, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS (SELECT iid, item_id, unnest(ts) AS term FROM i),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, nd),
c AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))) AS c
  FROM f JOIN w USING (term), s),
r AS (SELECT iid, item_id, rid, doc_id, sum(c)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
WINDOW o AS (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 50"""
