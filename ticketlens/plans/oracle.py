"""DuckDB oracle SQL for the registered queries.

Only the base tables are registered on the DuckDB side, so the adapter
views of ``sources.tables`` are inlined as CTEs. The SQL is written
independently of the Spark operators (term joins, window ranks, a brute
force pair table for the top-k check) and must give the same rows.
"""

from __future__ import annotations

WS = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"

TICKETS = """
tickets AS (
  SELECT d.doc_id AS ticket_id, d.source AS subject, d.text AS description, d.lang AS category,
         CASE WHEN d.n_chars >= 4000 THEN 'High' WHEN d.n_chars >= 1000 THEN 'Medium' ELSE 'Low' END AS priority,
         CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

LOG = """
preds AS (
  SELECT event_id AS id, event_type AS subject, props AS description, event_type AS pred_category,
         CASE WHEN value >= 60 THEN 'High' WHEN value >= 20 THEN 'Medium' ELSE 'Low' END AS pred_priority,
         CASE WHEN event_type = 'error' THEN 'Negative' WHEN event_type = 'purchase' THEN 'Positive'
              ELSE 'Neutral' END AS pred_sentiment,
         CAST(printf('%.4f', 50.0::DOUBLE / (value + 50.0::DOUBLE)) AS DOUBLE) AS confidence,
         CAST(printf('%.3f', value) AS DOUBLE) AS latency_ms,
         50.0::DOUBLE / (value + 50.0::DOUBLE) < 0.60 AS requires_review,
         false AS reviewed,
         ts AS ts
  FROM events
),
actions AS (
  SELECT user_id AS ticket_id FROM events WHERE event_type = 'click'
  UNION ALL
  SELECT event_id + 1000000000 AS ticket_id FROM events WHERE event_type = 'view'
),
log AS (
  SELECT p.id, p.subject, p.description, p.pred_category, p.pred_priority, p.pred_sentiment,
         p.confidence, p.latency_ms, p.requires_review,
         (p.reviewed OR a.id IS NOT NULL) AS reviewed, p.ts
  FROM preds p LEFT JOIN (SELECT DISTINCT ticket_id AS id FROM actions) a ON p.id = a.id
)"""


DIRTY = """
dirty AS (
  SELECT ticket_id, CASE WHEN ticket_id % 7 = 0 THEN NULL WHEN ticket_id % 11 = 0 THEN '' WHEN ticket_id % 13 = 0 THEN ' '
                         ELSE subject END AS subject,
         description, CASE WHEN ticket_id % 9 <> 0 THEN category END AS category, priority, sentiment
  FROM tickets
)"""


def _with(*ctes):
    return "WITH " + ",".join(ctes)


CORPUS_TEXT = f"""
ct AS (
  SELECT ticket_id, subject, category,
         trim(regexp_replace(lower(coalesce(subject, '') || ' ' || coalesce(description, '')),
                             '{WS}+', ' ', 'g')) AS text
  FROM tickets
)"""


def _terms(src, key):
    return f"""
{src}_tok AS (SELECT {key}, regexp_extract_all(lower(text), '{TOKEN}') AS tk FROM {src}),
{src}_terms AS (
  SELECT {key}, unnest(tk) AS term FROM {src}_tok
  UNION ALL
  SELECT {key}, unnest(list_transform(generate_series(1, len(tk) - 1),
                                      lambda i: tk[i] || ' ' || tk[i + 1])) AS term FROM {src}_tok
),
{src}_tf AS (SELECT {key}, term, count(*) AS tf FROM {src}_terms GROUP BY {key}, term)"""


VOCAB = """
nd AS (SELECT count(*) AS n FROM tickets),
dfs AS (SELECT term, count(*) AS df FROM ct_tf GROUP BY term),
vocab AS (
  SELECT term, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
  FROM dfs, nd WHERE df >= 2 AND df <= 0.9::DOUBLE * n
)"""


def _weights(src, key):
    return f"""
{src}_raw AS (
  SELECT t.{key}, t.term, (1.0::DOUBLE + ln(t.tf)) * v.idf AS w FROM {src}_tf t JOIN vocab v ON t.term = v.term
),
{src}_w AS (
  SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {src}_raw
)"""


QUERIES = f"""
qt AS (
  SELECT item_id AS query_id,
         regexp_replace(lower('' || ' ' || text), '^{WS}+|{WS}+$', '', 'g') AS text
  FROM benchmark
)"""

TFIDF = [TICKETS, CORPUS_TEXT, _terms("ct", "ticket_id"), VOCAB, _weights("ct", "ticket_id")]
QTFIDF = TFIDF + [QUERIES, _terms("qt", "query_id"), _weights("qt", "query_id")]


def _topk_sql(qsrc, k=3):
    return f"""
sc AS (
  SELECT q.query_id, c.ticket_id, sum(q.weight * c.weight) AS score
  FROM {qsrc}_w q JOIN ct_w c ON q.term = c.term GROUP BY q.query_id, c.ticket_id
),
allpairs AS (
  SELECT q.query_id, t.ticket_id FROM (SELECT DISTINCT query_id FROM {qsrc}) q CROSS JOIN (SELECT ticket_id FROM tickets) t
),
scored AS (
  SELECT a.query_id, a.ticket_id, coalesce(s.score, 0.0) AS score
  FROM allpairs a LEFT JOIN sc s ON a.query_id = s.query_id AND a.ticket_id = s.ticket_id
),
ranked AS (
  SELECT query_id, ticket_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, ticket_id DESC) AS rank
  FROM scored
),
topk AS (
  SELECT r.query_id, r.rank, r.ticket_id, t.subject, t.category, CAST(printf('%.4f', r.score) AS DOUBLE) AS score,
         CAST(printf('%.0f', CAST(printf('%.4f', r.score) AS DOUBLE) * 100) AS DOUBLE) AS match_pct
  FROM ranked r JOIN tickets t ON r.ticket_id = t.ticket_id WHERE r.rank <= {k}
)"""


def _emb(train: str = "") -> str:
    """Scored embeddings; ``train`` restricts the rows of the centroids."""
    return _EMB.replace("{train}", train)


_EMB = """
emb AS (
  SELECT vec_id, embedding, CAST(label AS VARCHAR) AS category,
         CASE label % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority,
         CASE CAST(floor(label / 4.0) AS INTEGER) WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS sentiment
  FROM embeddings
),
ex AS (
  SELECT vec_id, category, priority, sentiment,
         unnest(generate_series(1, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM emb
),
cen AS (
  SELECT 'category' AS target, category AS label, pos, avg(x) AS m FROM ex {train} GROUP BY category, pos
  UNION ALL SELECT 'priority', priority, pos, avg(x) FROM ex {train} GROUP BY priority, pos
  UNION ALL SELECT 'sentiment', sentiment, pos, avg(x) FROM ex {train} GROUP BY sentiment, pos
),
icpt AS (SELECT target, label, sum(m * m) * -40.0::DOUBLE AS b FROM cen GROUP BY target, label),
z AS (
  SELECT e.vec_id, c.target, c.label, sum(e.x * (c.m * 80.0::DOUBLE)) + i.b AS z
  FROM ex e JOIN cen c ON e.pos = c.pos JOIN icpt i ON c.target = i.target AND c.label = i.label
  GROUP BY e.vec_id, c.target, c.label, i.b
),
zr AS (
  SELECT vec_id, target, label, z,
         max(z) OVER (PARTITION BY vec_id, target) AS zmax,
         row_number() OVER (PARTITION BY vec_id, target ORDER BY z DESC, label ASC) AS rn
  FROM z
),
conf AS (SELECT vec_id, 1.0::DOUBLE / sum(exp(z - zmax)) AS raw FROM zr WHERE target = 'category' GROUP BY vec_id),
scored_emb AS (
  SELECT e.vec_id, e.category, e.priority, e.sentiment,
         max(CASE WHEN zr.target = 'category' AND zr.rn = 1 THEN zr.label END) AS pred_category,
         max(CASE WHEN zr.target = 'priority' AND zr.rn = 1 THEN zr.label END) AS pred_priority,
         max(CASE WHEN zr.target = 'sentiment' AND zr.rn = 1 THEN zr.label END) AS pred_sentiment,
         max(c.raw) AS raw_confidence,
         CAST(printf('%.4f', max(c.raw)) AS DOUBLE) AS confidence,
         max(c.raw) < 0.60 AS requires_review
  FROM emb e JOIN zr ON e.vec_id = zr.vec_id JOIN conf c ON e.vec_id = c.vec_id
  GROUP BY e.vec_id, e.category, e.priority, e.sentiment
),
pairs AS (
  SELECT 'category' AS target, category AS y, pred_category AS yhat FROM scored_emb
  UNION ALL SELECT 'priority', priority, pred_priority FROM scored_emb
  UNION ALL SELECT 'sentiment', sentiment, pred_sentiment FROM scored_emb
)"""

EMB = _emb()

METRIC_CTES = """
cls AS (
  SELECT target, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support FROM (
    SELECT target, y AS label, CASE WHEN y = yhat THEN 1 ELSE 0 END AS tp, 0 AS fp,
           CASE WHEN y <> yhat THEN 1 ELSE 0 END AS fn, 1 AS support FROM {p}
    UNION ALL
    SELECT target, yhat, 0, 1, 0, 0 FROM {p} WHERE y <> yhat
  ) GROUP BY target, label
),
pc AS (
  SELECT target, label,
         CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN (2.0 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
         support
  FROM cls
)"""


def _split(src, key, label, seed=42):
    return f"""
{src}_cnt AS (SELECT {label} AS label, count(*) AS n_c FROM {src} WHERE {label} IS NOT NULL GROUP BY {label}),
{src}_tot AS (SELECT sum(n_c) AS n, sum(n_c) - ceil(0.2::DOUBLE * sum(n_c)) AS n_train FROM {src}_cnt),
{src}_ex AS (
  SELECT c.label, c.n_c, t.n_train, floor(c.n_c * t.n_train / t.n) AS base,
         c.n_c * t.n_train / t.n - floor(c.n_c * t.n_train / t.n) AS rem
  FROM {src}_cnt c, {src}_tot t
),
{src}_al AS (
  SELECT label, n_c,
         n_c - (base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label ASC)
                                 <= n_train - sum(base) OVER () THEN 1 ELSE 0 END) AS n_test_c
  FROM {src}_ex
),
{src}_split AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.{label} ORDER BY md5('{seed}:' || CAST(s.{key} AS VARCHAR)))
              <= a.n_test_c AS is_test
  FROM {src} s JOIN {src}_al a ON s.{label} = a.label
)"""


def _log_view():
    return _with(LOG)


SQL = {}

SQL["q_kpis"] = _with(LOG) + """
SELECT count(id) AS total_tickets,
       CAST(printf('%.4f', coalesce(avg(confidence), 0.0)) AS DOUBLE) AS avg_confidence,
       CAST(printf('%.3f', coalesce(avg(latency_ms), 0.0)) AS DOUBLE) AS avg_latency_ms,
       count(*) FILTER (WHERE requires_review) AS flagged_for_review
FROM log"""

for _dim in ("category", "sentiment"):
    SQL[f"q_{_dim}_dist"] = _with(LOG) + f"""
SELECT pred_{_dim}, count(id) AS n FROM log GROUP BY pred_{_dim}"""

SQL["q_priority_dist"] = _with(LOG) + """
SELECT pred_priority, count(id) AS n,
       CASE pred_priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 END AS priority_rank
FROM log GROUP BY pred_priority"""

SQL["q_daily_counts"] = _with(LOG) + """
SELECT strftime(ts, '%Y-%m-%d') AS date, count(id) AS n FROM log GROUP BY 1 ORDER BY 1"""

_ROLLUP = """
r AS (
  SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(sentiment) = 0 THEN 'sentiment'
              WHEN grouping(priority) = 0 THEN 'priority' WHEN grouping(day) = 0 THEN 'day'
              ELSE 'all' END AS dimension,
         coalesce(category, sentiment, priority, day) AS label,
         count(id) AS n, sum(confidence) AS sc, sum(latency_ms) AS sl,
         count(*) FILTER (WHERE requires_review) AS flagged
  FROM (SELECT id, confidence, latency_ms, requires_review, pred_category AS category,
               pred_sentiment AS sentiment, pred_priority AS priority, strftime(ts, '%Y-%m-%d') AS day FROM log)
  GROUP BY GROUPING SETS ((category), (sentiment), (priority), (day), ())
)"""

SQL["q_analytics_rollup"] = _with(LOG, _ROLLUP) + """
SELECT dimension, label, n,
       CAST(printf('%.4f', coalesce(sc / n, 0.0)) AS DOUBLE) AS avg_confidence,
       CAST(printf('%.3f', coalesce(sl / n, 0.0)) AS DOUBLE) AS avg_latency_ms,
       coalesce(flagged, 0) AS flagged
FROM r"""

SQL["q_analytics_bundle"] = _with(LOG, _ROLLUP) + """
SELECT max(CASE WHEN dimension = 'all' THEN n END) AS total_tickets,
       string_agg(CASE WHEN dimension = 'category' THEN label || '=' || CAST(n AS VARCHAR) END, ',' ORDER BY label) AS category_dist,
       string_agg(CASE WHEN dimension = 'sentiment' THEN label || '=' || CAST(n AS VARCHAR) END, ',' ORDER BY label) AS sentiment_dist,
       string_agg(CASE WHEN dimension = 'priority' THEN label || '=' || CAST(n AS VARCHAR) END, ',' ORDER BY label) AS priority_dist,
       CAST(printf('%.4f', coalesce(max(CASE WHEN dimension = 'all' THEN sc END) / max(CASE WHEN dimension = 'all' THEN n END), 0.0)) AS DOUBLE) AS avg_confidence,
       CAST(printf('%.3f', coalesce(max(CASE WHEN dimension = 'all' THEN sl END) / max(CASE WHEN dimension = 'all' THEN n END), 0.0)) AS DOUBLE) AS avg_latency_ms,
       coalesce(max(CASE WHEN dimension = 'all' THEN flagged END), 0) AS flagged_for_review,
       string_agg(CASE WHEN dimension = 'day' THEN label || '=' || CAST(n AS VARCHAR) END, ',' ORDER BY label) AS tickets_over_time
FROM r"""

SQL["q_confidence_band"] = _with(LOG) + """
SELECT id, pct AS confidence_pct,
       CASE WHEN pct >= 75 THEN 'green' WHEN pct >= 60 THEN 'amber' ELSE 'red' END AS ticket_band,
       CASE WHEN pct >= 50 THEN 'amber' ELSE 'red' END AS queue_band,
       CASE WHEN pct >= 75 THEN 'green' ELSE 'amber' END AS kpi_band
FROM (SELECT id, CAST(printf('%.1f', confidence * 100) AS DOUBLE) AS pct FROM log)"""

SQL["q_review_flag"] = """
SELECT event_id AS id, CAST(printf('%.4f', 50.0::DOUBLE / (value + 50.0::DOUBLE)) AS DOUBLE) AS confidence,
       50.0::DOUBLE / (value + 50.0::DOUBLE) < 0.60 AS requires_review
FROM events"""

SQL["q_review_queue"] = _with(LOG) + """
SELECT id, subject, description, pred_category, pred_priority, pred_sentiment, confidence,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS "timestamp"
FROM (SELECT * FROM log WHERE requires_review AND NOT reviewed ORDER BY ts DESC, id DESC LIMIT 50)"""

SQL["q_mark_reviewed"] = _with(LOG) + """
SELECT id, requires_review, reviewed FROM log"""

SQL["q_unknown_reviews"] = _with(LOG) + """
SELECT DISTINCT a.ticket_id FROM actions a
WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.id = a.ticket_id)"""

SQL["q_reply_prompt"] = _with(LOG) + """
SELECT id, 'Ticket Category : ' || pred_category || chr(10) ||
           'Priority        : ' || pred_priority || chr(10) ||
           'Customer Tone   : ' || pred_sentiment || chr(10) ||
           'Subject         : ' || subject || chr(10) ||
           'Description     : ' || description || chr(10) || chr(10) ||
           'Write a suggested reply for the support agent to send to this customer.' AS prompt
FROM log"""

SQL["q_build_text"] = _with(TICKETS, CORPUS_TEXT) + """
SELECT ticket_id, text FROM ct"""

SQL["q_build_text_serving"] = _with(TICKETS) + f"""
SELECT ticket_id, regexp_replace(lower(subject || ' ' || description), '^{WS}+|{WS}+$', '', 'g') AS text
FROM tickets"""

SQL["q_corpus"] = _with(TICKETS, CORPUS_TEXT) + """
SELECT t.ticket_id, t.subject, t.description, t.category, c.text
FROM tickets t JOIN ct c ON t.ticket_id = c.ticket_id"""

SQL["q_tokens"] = _with(TICKETS, CORPUS_TEXT) + f"""
SELECT ticket_id, unnest(generate_series(0, len(tk) - 1)) AS pos, unnest(tk) AS token
FROM (SELECT ticket_id, regexp_extract_all(lower(text), '{TOKEN}') AS tk FROM ct)"""

SQL["q_ngrams"] = _with(TICKETS, CORPUS_TEXT, _terms("ct", "ticket_id")) + """
SELECT ticket_id, term, tf FROM ct_tf"""

SQL["q_vocabulary"] = _with(TICKETS, CORPUS_TEXT, _terms("ct", "ticket_id"), VOCAB) + """
SELECT term, df, round(idf, 10) AS idf FROM vocab"""

SQL["q_tfidf_weights"] = _with(*TFIDF) + """
SELECT ticket_id, term, round(weight, 10) AS weight FROM ct_w"""

SQL["q_similar_new"] = _with(*QTFIDF) + """
SELECT query_id, term, round(weight, 10) AS weight FROM qt_w"""

SQL["q_similar_scores"] = _with(*QTFIDF) + """
SELECT q.query_id, c.ticket_id, round(sum(q.weight * c.weight), 8) AS score
FROM qt_w q JOIN ct_w c ON q.term = c.term GROUP BY q.query_id, c.ticket_id"""

SQL["q_similar_topk"] = _with(*QTFIDF, _topk_sql("qt")) + """
SELECT * FROM topk"""

SQL["q_score_linear"] = _with(EMB) + """
SELECT vec_id, pred_category, confidence, requires_review FROM scored_emb"""

SQL["q_score_multi"] = _with(EMB) + """
SELECT vec_id, pred_category, pred_priority, pred_sentiment, confidence, requires_review FROM scored_emb"""

_BATCH = """
bt AS (
  SELECT t.ticket_id, t.subject, t.description, s.pred_category, s.pred_priority, s.pred_sentiment,
         s.confidence, s.requires_review
  FROM scored_emb s JOIN tickets t ON s.vec_id = t.ticket_id
  WHERE t.subject IS NOT NULL AND length(t.subject) >= 1 AND t.description IS NOT NULL AND length(t.description) >= 1
)"""

SQL["q_prediction_log"] = _with(TICKETS, EMB, _BATCH) + """
SELECT ticket_id AS id, subject, description, pred_category, pred_priority, pred_sentiment, confidence,
       0.0::DOUBLE AS latency_ms, requires_review, false AS reviewed
FROM bt"""

SQL["q_batch_score"] = _with(TICKETS, EMB, _BATCH) + """
SELECT ticket_id, subject, description, pred_category AS "Category", pred_priority AS "Priority",
       pred_sentiment AS "Sentiment",
       CAST(printf('%.1f', confidence * 100) AS DOUBLE) AS "Confidence (%)",
       requires_review AS "Needs Review"
FROM bt"""

SQL["q_batch_summary"] = _with(TICKETS, EMB, _BATCH) + """
SELECT count(*) AS count, 0.0::DOUBLE AS avg_latency_ms, count(*) FILTER (WHERE requires_review) AS flagged
FROM bt"""

SQL["q_validate"] = _with(TICKETS, DIRTY) + """
SELECT ticket_id,
       CASE WHEN subject IS NULL THEN 'subject_missing' WHEN length(subject) < 1 THEN 'subject_empty'
            WHEN description IS NULL THEN 'description_missing' WHEN length(description) < 1 THEN 'description_empty'
       END AS reject_reason
FROM dirty"""

_TRIAGE_Q = f"""
tq AS (
  SELECT t.ticket_id AS query_id,
         regexp_replace(lower(t.subject || ' ' || t.description), '^{WS}+|{WS}+$', '', 'g') AS text
  FROM tickets t JOIN embeddings e ON e.vec_id = t.ticket_id
)"""

SQL["q_triage"] = _with(*TFIDF, EMB, _TRIAGE_Q, _terms("tq", "query_id"), _weights("tq", "query_id"),
                        _topk_sql("tq")) + """
SELECT s.vec_id AS ticket_id, s.pred_category, s.pred_priority, s.pred_sentiment, s.confidence, s.requires_review,
       k.rank AS similar_rank, k.ticket_id AS similar_id, k.subject AS similar_subject,
       k.category AS similar_category, k.score AS similar_score
FROM scored_emb s JOIN topk k ON s.vec_id = k.query_id"""

_LABEL_LONG = """
ll AS (
  SELECT 'category' AS target, category AS label FROM dirty
  UNION ALL SELECT 'priority', priority FROM dirty
  UNION ALL SELECT 'sentiment', sentiment FROM dirty
)"""

SQL["q_label_counts"] = _with(TICKETS, DIRTY, _LABEL_LONG) + """
SELECT target, count(*) AS rows, count(DISTINCT label) AS n_labels,
       count(*) FILTER (WHERE label IS NULL) AS null_labels
FROM ll GROUP BY target"""

SQL["q_metadata"] = _with(TICKETS, DIRTY, _LABEL_LONG) + """
SELECT target, row_number() OVER (PARTITION BY target ORDER BY label) - 1 AS label_index, label
FROM (SELECT DISTINCT target, label FROM ll WHERE label IS NOT NULL)"""

SQL["q_split"] = _with(TICKETS, _split("tickets", "ticket_id", "category")) + """
SELECT ticket_id, category, is_test FROM tickets_split"""

SQL["q_class_weights"] = _with(TICKETS, _split("tickets", "ticket_id", "category")) + """
, tr AS (SELECT * FROM tickets_split WHERE NOT is_test),
cw AS (
  SELECT 'category' AS target, category AS label, count(*) AS n_c FROM tr GROUP BY category
  UNION ALL SELECT 'priority', priority, count(*) FROM tr GROUP BY priority
  UNION ALL SELECT 'sentiment', sentiment, count(*) FROM tr GROUP BY sentiment
)
SELECT target, label, n_c,
       round(sum(n_c) OVER (PARTITION BY target) / (count(*) OVER (PARTITION BY target) * n_c), 10) AS weight
FROM cw"""

SQL["q_accuracy"] = _with(EMB) + """
SELECT target, count(*) AS n, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 10) AS accuracy
FROM pairs GROUP BY target"""

SQL["q_macro_prf"] = _with(EMB, METRIC_CTES.format(p="pairs")) + """
SELECT target, round(avg(precision), 10) AS precision, round(avg(recall), 10) AS recall,
       round(avg(f1), 10) AS f1
FROM pc GROUP BY target"""

SQL["q_class_report"] = _with(EMB, METRIC_CTES.format(p="pairs")) + """
SELECT target, label, round(precision, 10) AS precision, round(recall, 10) AS recall,
       round(f1, 10) AS f1, support FROM pc
UNION ALL
SELECT target, 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1), 10),
       CAST(sum(support) AS BIGINT)
FROM pc GROUP BY target
UNION ALL
SELECT target, 'weighted avg',
       round(CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END, 10),
       round(CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END, 10),
       round(CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END, 10),
       CAST(sum(support) AS BIGINT)
FROM pc GROUP BY target"""

SQL["q_confusion"] = _with(EMB) + """
, lab AS (SELECT DISTINCT target, y AS label FROM pairs),
sq AS (SELECT a.target, a.label AS true_label, b.label AS pred_label FROM lab a JOIN lab b ON a.target = b.target),
cnt AS (SELECT target, y, yhat, count(*) AS n FROM pairs GROUP BY target, y, yhat)
SELECT sq.target, sq.true_label, sq.pred_label, coalesce(cnt.n, 0) AS n
FROM sq LEFT JOIN cnt ON sq.target = cnt.target AND sq.true_label = cnt.y AND sq.pred_label = cnt.yhat"""

_EMB_SPLIT = """
emb0 AS (SELECT vec_id, CAST(label AS VARCHAR) AS category FROM embeddings),""" + _split("emb0", "vec_id", "category").lstrip("\n")
_HELD_OUT = _with(_EMB_SPLIT, _emb("WHERE vec_id IN (SELECT vec_id FROM emb0_split WHERE NOT is_test)"), """
scored_emb_split AS (SELECT s.*, e.is_test FROM scored_emb s JOIN emb0_split e USING (vec_id))""")

SQL["q_eval_pairs"] = _HELD_OUT + """
SELECT vec_id, category AS true_category, priority AS true_priority, sentiment AS true_sentiment,
       pred_category, pred_priority, pred_sentiment
FROM scored_emb_split WHERE is_test"""

SQL["q_report"] = _HELD_OUT + """
, tp AS (
  SELECT 'category' AS target, category AS y, pred_category AS yhat FROM scored_emb_split WHERE is_test
  UNION ALL SELECT 'priority', priority, pred_priority FROM scored_emb_split WHERE is_test
  UNION ALL SELECT 'sentiment', sentiment, pred_sentiment FROM scored_emb_split WHERE is_test
),
""" + METRIC_CTES.format(p="tp").lstrip() + """,
acc AS (SELECT target, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS accuracy FROM tp GROUP BY target),
f AS (SELECT target, avg(f1) AS f1 FROM pc GROUP BY target)
SELECT 'phase3' AS phase, acc.target, 'embeddings' AS dataset, (SELECT count(*) FROM embeddings) AS rows,
       'centroid linear head' AS model, CAST(printf('%.4f', acc.accuracy) AS DOUBLE) AS accuracy, CAST(printf('%.4f', f.f1) AS DOUBLE) AS f1_macro
FROM acc JOIN f ON acc.target = f.target"""


SQL["q_quarantine"] = _with(TICKETS) + """
SELECT ticket_id, CASE WHEN subject IS NULL THEN 'subject_missing' WHEN length(subject) < 1 THEN 'subject_empty'
    WHEN description IS NULL THEN 'description_missing' WHEN length(description) < 1 THEN 'description_empty'
    ELSE 'embedding_missing' END AS reject_reason
FROM tickets t LEFT JOIN embeddings e ON e.vec_id = t.ticket_id
WHERE e.vec_id IS NULL OR coalesce(length(subject), 0) < 1 OR coalesce(length(description), 0) < 1"""

SQL["q_triage_log"] = _with(*TFIDF, EMB, _TRIAGE_Q, _terms("tq", "query_id"), _weights("tq", "query_id"), _topk_sql("tq")) + """
, nearest AS (SELECT query_id, string_agg(ticket_id || '=' || printf('%.4f', score), ',' ORDER BY rank) AS similar_tickets FROM topk GROUP BY 1)
SELECT s.vec_id AS id, s.pred_category, s.pred_priority, s.pred_sentiment, s.confidence, s.requires_review, false AS reviewed, k.similar_tickets
FROM scored_emb s JOIN nearest k ON s.vec_id = k.query_id"""

SQL["q_log_lookup"] = _with(LOG) + """
SELECT id, pred_category, confidence FROM preds WHERE id IN (SELECT ticket_id FROM actions)"""

SQL["q_preview"] = _with(TICKETS) + """
SELECT ticket_id, subject, category FROM tickets ORDER BY ticket_id LIMIT 5"""

SQL["q_null_labels"] = _with(TICKETS, DIRTY) + """
SELECT ticket_id, CASE WHEN category IS NULL THEN 'category_missing' WHEN priority IS NULL THEN 'priority_missing'
    ELSE 'sentiment_missing' END AS reject_reason
FROM dirty WHERE category IS NULL OR priority IS NULL OR sentiment IS NULL"""

_EVAL = """
ev AS (SELECT 'priority' AS target, priority AS y,
              CASE WHEN ticket_id % 3 = 0 THEN 'Low' WHEN ticket_id % 50 = 1 THEN 'Urgent' ELSE priority END AS yhat FROM tickets)"""
SQL["q_eval_report"] = SQL["q_class_report"].replace(_with(EMB, METRIC_CTES.format(p="pairs")), _with(TICKETS, _EVAL, METRIC_CTES.format(p="ev")))


def _trained(src: str, key: str, targets, phase: str = "") -> str:
    """The solver-independent columns of a fitted phase on ``src``."""
    parts = []
    for t in targets:
        parts.append(f"""
SELECT {phase}'{t}' AS target, (SELECT count(*) FROM {src}_split WHERE NOT is_test) AS train_rows,
       (SELECT count(*) FROM {src}_split WHERE is_test) AS test_rows,
       (SELECT count(DISTINCT {t}) FROM {src}_split WHERE NOT is_test) AS n_classes,
       round((SELECT avg(CASE WHEN {t} = (SELECT {t} FROM {src}_split WHERE NOT is_test GROUP BY {t} ORDER BY count(*) DESC, {t} LIMIT 1)
                              THEN 1.0::DOUBLE ELSE 0.0 END) FROM {src}_split WHERE is_test), 10) AS majority_accuracy,
       true AS learned""")
    return " UNION ALL ".join(parts)


_TARGETS = ("category", "priority", "sentiment")
_EMB_ROWS = _EMB[: _EMB.index(",\nex AS")]
_LABELLED = """
labelled AS (SELECT * FROM tickets WHERE ticket_id IN (SELECT doc_id FROM labels))"""
SQL["q_train_embedding"] = _with(_EMB_ROWS, _split("emb", "vec_id", "category")) + _trained("emb", "vec_id", _TARGETS)
SQL["q_train_tfidf"] = _with(TICKETS, _split("tickets", "ticket_id", "category")) + _trained("tickets", "ticket_id", ("category",))
SQL["q_phase_report"] = _with(
    TICKETS, _LABELLED, _split("labelled", "ticket_id", "category"), _split("tickets", "ticket_id", "category"),
    _EMB_ROWS, _split("emb", "vec_id", "category")) + " UNION ALL ".join([
        _trained("labelled", "ticket_id", ("category",), "'phase1' AS phase, "),
        _trained("tickets", "ticket_id", ("category",), "'phase2' AS phase, "),
        _trained("emb", "vec_id", _TARGETS, "'phase3' AS phase, ")])

SQL["q_bundle_incremental"] = SQL["q_analytics_bundle"]
SQL["q_index_segments"] = SQL["q_vocabulary"]


def oracle_sql() -> dict:
    return dict(SQL)
