"""The expected result of each query, as SQL over the given tables."""

from __future__ import annotations

ATTEMPTS = """
attempts_v AS (
  SELECT user_id AS pi, CAST(CAST(ts AS DATE) AS VARCHAR) AS filename, event_id, ts,
    ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS seq,
    CASE event_type WHEN 'view' THEN 'done' WHEN 'purchase' THEN 'skipped' END AS result,
    CASE WHEN event_type = 'click' THEN 'HTTP 429 Too Many Requests'
         WHEN event_type = 'signup' THEN 'Invalid Image Format: item ' || CAST(event_id AS VARCHAR)
         WHEN event_type = 'error' AND event_id % 3 = 0 THEN '400 Failed to download image'
         WHEN event_type = 'error' THEN '503 upstream timeout' END AS message
  FROM events),
classified_v AS (
  SELECT *, CASE WHEN result IS NOT NULL THEN result
    WHEN contains(lower(message), '429') OR contains(lower(message), 'rate limit')
      OR contains(lower(message), 'too many requests')
      OR contains(lower(message), 'rate_limit_exceeded') THEN 'rate_limit'
    WHEN contains(lower(message), 'unsupported base64 file format')
      OR contains(lower(message), 'unsupported file format')
      OR contains(lower(message), 'invalid image format')
      OR contains(lower(message), 'failed to process some items')
      OR contains(lower(message), 'invalid url') OR contains(lower(message), 'image too large')
      OR contains(lower(message), 'unable to decode image')
      OR contains(lower(message), 'corrupted image') THEN 'permanent'
    ELSE 'transient' END AS outcome
  FROM attempts_v)"""

FOLD = f"""
WITH {ATTEMPTS},
a AS (
  SELECT *, SUM(CASE WHEN outcome IN ('rate_limit', 'transient') THEN 1 ELSE 0 END) OVER (
    PARTITION BY pi, filename ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
    ) AS fails
  FROM classified_v),
t AS (
  SELECT pi, filename, MAX(fails) AS all_fails,
    MIN(CASE WHEN outcome IN ('done', 'skipped', 'permanent')
      OR (outcome = 'transient' AND fails >= 3) THEN seq END) AS tseq
  FROM a GROUP BY pi, filename)
SELECT t.pi, t.filename,
  CASE WHEN t.tseq IS NULL THEN 'pending' WHEN a.outcome IN ('done', 'skipped') THEN a.outcome
    ELSE 'error' END AS status,
  CAST(COALESCE(a.fails, t.all_fails) AS BIGINT) AS retry_count,
  CASE a.outcome WHEN 'permanent' THEN 'Permanent OCR failure: ' || a.message
    WHEN 'transient' THEN 'Failed after 3 retries: OCR failed: ' || a.message END AS error
FROM t LEFT JOIN a ON a.pi = t.pi AND a.filename = t.filename AND a.seq = t.tseq"""

CHUNK_OF = (
    "CAST(floor({key} / 10.0) AS BIGINT) AS chunk_id, "
    "'b' || CAST(CAST(floor(floor({key} / 10.0) / 100.0) AS BIGINT) AS VARCHAR) AS batch_id"
)

PIS = f"""
pis_v AS (
  SELECT o_orderkey AS pi, {CHUNK_OF.format(key="o_orderkey")}, o_orderdate,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 'CAS failure' END AS entity_error,
    CASE WHEN o_orderkey % 3 = 1 THEN 'tip' || CAST(o_orderkey AS VARCHAR) END AS new_tip,
    NULLIF(o_orderkey % 3, 0) AS new_version
  FROM orders)"""

REFS = f"""
refs_v AS (
  SELECT l_orderkey AS pi, {CHUNK_OF.format(key="l_orderkey")},
    CAST(l_linenumber AS VARCHAR) || '.ref.json' AS filename,
    CASE MAX(l_returnflag || l_linestatus) WHEN 'AF' THEN 'done' WHEN 'AO' THEN 'skipped'
      WHEN 'NF' THEN 'done' WHEN 'NO' THEN 'pending' ELSE 'error' END AS status,
    CASE WHEN MAX(l_returnflag || l_linestatus) = 'RF' THEN '503 upstream timeout' END AS error,
    'cid' || CAST(MAX(l_partkey) AS VARCHAR) AS result_cid
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

RESULTS = f"""{PIS}, {REFS},
counted_v AS (
  SELECT p.pi, p.chunk_id, p.batch_id, p.entity_error, p.new_tip, p.new_version,
    COUNT(r.status) AS total_refs,
    COUNT(CASE WHEN r.status = 'done' THEN 1 END) AS completed,
    COUNT(CASE WHEN r.status = 'skipped' THEN 1 END) AS skipped,
    COUNT(CASE WHEN r.status = 'error' THEN 1 END) AS failed
  FROM pis_v p LEFT JOIN refs_v r ON r.pi = p.pi
  GROUP BY p.pi, p.chunk_id, p.batch_id, p.entity_error, p.new_tip, p.new_version),
results_v AS (
  SELECT *, completed + skipped AS refs_completed, failed AS refs_failed,
    CASE WHEN entity_error IS NOT NULL THEN 'error'
      WHEN failed > 0 AND completed + skipped > 0 THEN 'partial'
      WHEN failed > 0 THEN 'error' ELSE 'success' END AS status
  FROM counted_v)"""

CHUNKS = """
chunks_v AS (
  SELECT batch_id, chunk_id, started_at,
    CASE WHEN chunk_id % 4 <> 0 THEN ended_at END AS completed_at,
    CASE chunk_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FETCHING'
      ELSE 'DONE' END AS phase,
    CASE WHEN chunk_id % 6 = 0 THEN 'lost ' || CAST(chunk_id AS VARCHAR) END AS global_error
  FROM (
    SELECT batch_id, chunk_id, MIN(o_orderdate) AS started_at, MAX(o_orderdate) AS ended_at
    FROM pis_v GROUP BY batch_id, chunk_id
    UNION ALL
    SELECT 'empty', CAST(n_nationkey AS BIGINT), TIMESTAMP '2000-01-01 00:00:00',
      TIMESTAMP '2000-01-01 00:00:00' FROM nation) c)"""

REPORT = f"""{RESULTS}, {CHUNKS},
totals_v AS (
  SELECT batch_id, chunk_id, COUNT(*) AS n,
    COUNT(CASE WHEN status = 'success' THEN 1 END) AS n_ok,
    COUNT(CASE WHEN status = 'error' THEN 1 END) AS n_bad,
    SUM(total_refs) AS total_refs, SUM(completed) AS completed, SUM(failed) AS failed,
    SUM(skipped) AS skipped
  FROM results_v GROUP BY batch_id, chunk_id),
report_v AS (
  SELECT c.batch_id, c.chunk_id,
    CASE WHEN c.phase = 'ERROR' THEN 'error' WHEN t.n IS NULL OR t.n = t.n_ok THEN 'success'
      WHEN t.n = t.n_bad THEN 'error' ELSE 'partial' END AS status,
    CAST(COALESCE(t.total_refs, 0) AS BIGINT) AS total_refs,
    CAST(COALESCE(t.completed, 0) AS BIGINT) AS completed,
    CAST(COALESCE(t.failed, 0) AS BIGINT) AS failed,
    CAST(COALESCE(t.skipped, 0) AS BIGINT) AS skipped,
    epoch_ms(COALESCE(c.completed_at, TIMESTAMP '2001-01-01 00:00:00')) - epoch_ms(c.started_at)
      AS processing_time_ms,
    CASE WHEN c.phase = 'ERROR' THEN c.global_error END AS error
  FROM chunks_v c LEFT JOIN totals_v t ON t.batch_id = c.batch_id AND t.chunk_id = c.chunk_id)"""

TIPS = """
numbered_v AS (
  SELECT o_custkey AS entity, 'tip' || CAST(o_orderkey AS VARCHAR) AS tip, o_orderkey,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ver,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back
  FROM orders),
tips_v AS (SELECT entity, tip, CAST(ver AS BIGINT) AS ver FROM numbered_v WHERE back = 1)"""

COMPONENTS = f"""{TIPS},
components_v AS (
  SELECT v.entity, v.ver, v.o_orderkey AS version_id,
    CASE WHEN l.l_linenumber % 4 = 0 THEN 'meta' || CAST(l.l_linenumber AS VARCHAR) || '.json'
      ELSE 'img' || CAST(l.l_linenumber AS VARCHAR) || '.ref.json' END AS filename,
    MAX(l.l_partkey) AS partkey
  FROM numbered_v v JOIN lineitem l ON l.l_orderkey = v.o_orderkey
  GROUP BY v.entity, v.ver, v.o_orderkey, l.l_linenumber),
manifest_v AS (
  SELECT entity, filename, partkey FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, filename ORDER BY ver DESC) AS rn
    FROM components_v) x
  WHERE rn = 1)"""

FOUND = f"""{COMPONENTS},
found_v AS (
  SELECT CAST(floor(c_custkey / 10.0) AS BIGINT) AS chunk_id, c_custkey AS pi, m.filename,
    'cid' || CAST(m.partkey AS VARCHAR) AS original_cid, m.partkey,
    'https://cdn.example.org/asset/01AB' || CAST(m.partkey AS VARCHAR) || '/large' AS cdn_url
  FROM customer JOIN manifest_v m ON m.entity = c_custkey JOIN part ON p_partkey = m.partkey
  WHERE m.filename LIKE '%.ref.json'
    AND m.partkey % 19 <> 0 AND m.partkey % 13 <> 0 AND m.partkey % 11 <> 0)"""

PROCESSED = f"""
WITH {FOUND},
s AS (
  SELECT *, CASE WHEN partkey % 5 = 0 THEN 'skipped' WHEN partkey % 3 = 0 OR partkey % 7 = 0
    THEN 'error' ELSE 'done' END AS status FROM found_v),
p AS (
  SELECT c_custkey AS pi, CAST(floor(c_custkey / 10.0) AS BIGINT) AS chunk_id,
    COUNT(s.pi) AS total_refs, COUNT(CASE WHEN status = 'done' THEN 1 END) AS completed,
    COUNT(CASE WHEN status = 'error' THEN 1 END) AS failed,
    COUNT(CASE WHEN status = 'skipped' THEN 1 END) AS skipped
  FROM customer LEFT JOIN s ON s.pi = c_custkey GROUP BY 1, 2),
q AS (
  SELECT *, CASE WHEN failed > 0 AND completed + skipped > 0 THEN 'partial'
    WHEN failed > 0 THEN 'error' ELSE 'success' END AS status FROM p)
SELECT CAST(chunk_id AS VARCHAR) AS chunk_id,
  CASE WHEN bool_and(status = 'success') THEN 'success' WHEN bool_and(status = 'error')
    THEN 'error' ELSE 'partial' END AS status,
  CAST(SUM(total_refs) AS BIGINT) AS total_refs, CAST(SUM(completed) AS BIGINT) AS completed,
  CAST(SUM(failed) AS BIGINT) AS failed, CAST(SUM(skipped) AS BIGINT) AS skipped
FROM q GROUP BY chunk_id"""

PUBLISHED = f"""{FOUND},
states_v AS (
  SELECT *, 'text of part ' || CAST(partkey AS VARCHAR) AS old_text,
    CASE WHEN partkey % 5 = 0 THEN 'skipped' WHEN partkey % 3 = 0 OR partkey % 7 = 0 THEN 'error'
      ELSE 'done' END AS status FROM found_v),
versions_v AS (
  SELECT CAST(s.pi AS VARCHAR) AS entity, CAST(s.chunk_id AS VARCHAR) AS chunk_id,
    t.ver + 1 AS ver, t.tip AS prev_tip, COUNT(*) AS n
  FROM states_v s JOIN tips_v t ON t.entity = s.pi
  WHERE s.status IN ('done', 'skipped') GROUP BY 1, 2, 3, 4)"""

URLS = """
urls_v AS (
  SELECT page_id, html, CASE page_id % 4
      WHEN 0 THEN 'https://cdn.example.org/asset/01AB' || CAST(page_id AS VARCHAR) || '/large'
      WHEN 1 THEN 'http://cdn.example.org/asset/01AB' || CAST(page_id AS VARCHAR) || '?w=10'
      WHEN 2 THEN 'https://cdn.example.org/asset/lower' || CAST(page_id AS VARCHAR)
      ELSE url END AS cdn_url
  FROM pages)"""

UPDATES = f"""{TIPS},
updates_v AS (
  SELECT u.*, CASE WHEN update_id % 3 = 0 THEN t.tip ELSE 'tip-stale' END AS expect_tip,
    t.tip AS cur_tip, t.ver AS cur_ver
  FROM (
    SELECT CASE WHEN o_orderkey % 97 = 0 THEN -1 - o_custkey ELSE o_custkey END AS entity,
      o_orderkey AS update_id, o_orderkey % 5 + 1 AS n_components FROM orders) u
  LEFT JOIN tips_v t ON t.entity = u.entity),
r1 AS (SELECT entity, MIN(update_id) AS update_id FROM updates_v WHERE expect_tip = cur_tip
  GROUP BY entity),
rest1 AS (SELECT * FROM updates_v u WHERE cur_tip IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.update_id = u.update_id)),
r2 AS (SELECT entity, MIN(update_id) AS update_id FROM rest1 GROUP BY entity),
rest2 AS (SELECT * FROM rest1 u
  WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.update_id = u.update_id)),
r3 AS (SELECT entity, MIN(update_id) AS update_id FROM rest2 GROUP BY entity),
won AS (SELECT *, 1 AS round FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3),
placed AS (
  SELECT w.*, u.cur_tip,
    u.cur_ver + ROW_NUMBER() OVER (PARTITION BY w.entity ORDER BY w.round) AS new_version
  FROM won w JOIN updates_v u ON u.update_id = w.update_id),
tipped AS (
  SELECT *, sha256(CAST(entity AS VARCHAR) || '|' || CAST(new_version AS VARCHAR) || '|'
    || CAST(update_id AS VARCHAR)) AS new_tip FROM placed),
chained AS (
  SELECT *, COALESCE(LAG(new_tip) OVER (PARTITION BY entity ORDER BY round), cur_tip) AS prev_tip
  FROM tipped),
plan_v AS (
  SELECT u.entity, u.update_id, c.round IS NOT NULL AS committed, CAST(c.round AS BIGINT) AS round,
    c.new_version, c.new_tip, c.prev_tip, u.n_components,
    CASE WHEN c.round IS NOT NULL THEN NULL
      WHEN u.cur_tip IS NOT NULL THEN 'CAS failure for ' || CAST(u.entity AS VARCHAR)
      ELSE 'Entity not found: ' || CAST(u.entity AS VARCHAR) END AS entity_error
  FROM updates_v u LEFT JOIN chained c ON c.update_id = u.update_id)"""

FLAT = f"""
WITH {REPORT}
SELECT r.batch_id, r.chunk_id, r.pi, r.status, r.new_tip, r.new_version, r.refs_completed,
  r.refs_failed, f.filename,
  CASE WHEN f.filename IS NOT NULL THEN COALESCE(f.error, 'Unknown error') END AS error
FROM results_v r LEFT JOIN refs_v f ON f.pi = r.pi AND f.status = 'error'"""

STREAKS = """
steps_v AS (
  SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS hit FROM events),
groups_v AS (
  SELECT *, SUM(1 - hit) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM steps_v),
streaks_v AS (
  SELECT *, SUM(hit) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS streak FROM groups_v)"""

ORACLES: dict[str, str] = {
    "work_items": f"""
WITH {PIS}
SELECT batch_id, chunk_id, pi,
  ROW_NUMBER() OVER (PARTITION BY batch_id, chunk_id ORDER BY pi) - 1 AS pos FROM pis_v""",
    "request_validation": """
SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0
    THEN 'Missing required fields: batch_id, chunk_id, pis' END AS reason,
  CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 0 ELSE 1 END AS BIGINT)
    AS n_pis
FROM customer""",
    "admit_requests": """
WITH r AS (
  SELECT o_orderkey AS request_id, o_custkey AS chunk_id,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
    CASE o_custkey % 5 WHEN 1 THEN 'DONE' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'PROCESSING'
      WHEN 4 THEN 'PUBLISHING' END AS old
  FROM orders)
SELECT request_id, chunk_id,
  CASE WHEN rn = 1 AND (old IS NULL OR old IN ('DONE', 'ERROR')) THEN 'accepted'
    ELSE 'already_processing' END AS status,
  CASE WHEN old IN ('PROCESSING', 'PUBLISHING') THEN old WHEN rn > 1 THEN 'FETCHING' END AS phase
FROM r""",
    "key_violations": """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    "assign_chunks": """
SELECT o_orderkey AS pi,
  CAST(floor((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) / 10.0) AS BIGINT) AS chunk_id
FROM orders""",
    "latest_run": """
WITH newest AS (SELECT o_custkey AS chunk_id, MAX(o_orderkey) AS run_id FROM orders GROUP BY 1)
SELECT chunk_id, run_id, COUNT(*) AS n_rows FROM newest JOIN lineitem ON l_orderkey = run_id
GROUP BY chunk_id, run_id""",
    "url_variants": """
SELECT page_id,
  CASE WHEN page_id % 4 IN (0, 1)
    THEN 'https://cdn.example.org/asset/01AB' || CAST(page_id AS VARCHAR) || '/medium'
    WHEN page_id % 4 = 2 THEN 'https://cdn.example.org/asset/lower' || CAST(page_id AS VARCHAR)
    ELSE url END AS primary_url,
  CASE WHEN page_id % 4 IN (0, 1)
    THEN 'https://cdn.example.org/asset/01AB' || CAST(page_id AS VARCHAR) END AS fallback_url
FROM pages""",
    "error_classify": f"""
WITH {ATTEMPTS},
f AS (
  SELECT *, outcome = 'transient' AND event_id % 2 = 0 AND contains(message, '400')
    AND contains(lower(message), 'failed to download') AS use_fallback
  FROM classified_v WHERE message IS NOT NULL)
SELECT event_id, outcome, use_fallback,
  CASE outcome WHEN 'rate_limit' THEN 'Rate limited: ' WHEN 'permanent'
    THEN 'Permanent OCR failure: '
    ELSE CASE WHEN use_fallback THEN 'OCR fallback failed: ' ELSE 'OCR failed: ' END END
    || message AS message
FROM f""",
    "text_length": """
SELECT doc_id, length(text) + CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END AS n_units
FROM documents""",
    "network_tag": """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'II' WHEN 1 THEN 'ii' ELSE '01' END
  || CAST(c_custkey AS VARCHAR) AS pi,
  CASE WHEN c_custkey % 3 = 0 THEN 'test' END AS network
FROM customer""",
    "doc_merge": """
SELECT doc_id,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ''
    ELSE 'https://docs.example.org/' || source || '/' || CAST(doc_id AS VARCHAR) END AS url,
  CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS inner_id,
  CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang,
  CASE WHEN doc_id % 13 <> 0 THEN source END AS source,
  CASE WHEN doc_id % 13 <> 0 THEN sha256(text || ' "end"' || chr(10)) END AS ocr_id
FROM documents""",
    "manifest_lookup": f"""
WITH {TIPS}
SELECT p_partkey AS pi, tip, ver,
  CASE WHEN tip IS NULL THEN 'Entity ' || CAST(p_partkey AS VARCHAR) || ' not found' END
    AS fetch_error
FROM part LEFT JOIN tips_v ON entity = p_partkey""",
    "ref_components": f"""
WITH {COMPONENTS}
SELECT entity, version_id, filename, 'cid' || CAST(partkey AS VARCHAR) AS cid
FROM components_v WHERE filename LIKE 'img%'""",
    "content_lookup": """
SELECT doc_id,
  CASE WHEN doc_id % 19 = 0 THEN 'not_found' WHEN doc_id % 13 = 0 THEN 'bad_json'
    WHEN doc_id % 11 = 0 THEN 'no_url' END AS drop_reason,
  CASE WHEN doc_id % 19 <> 0 AND doc_id % 13 <> 0 AND doc_id % 11 <> 0
    THEN 'https://docs.example.org/' || source || '/' || CAST(doc_id AS VARCHAR) END AS cdn_url
FROM documents""",
    "discover_refs": f"""
WITH {FOUND} SELECT chunk_id, pi, filename, original_cid, cdn_url FROM found_v""",
    "discovery_totals": f"""
WITH {FOUND},
n AS (SELECT pi, COUNT(*) AS n FROM found_v GROUP BY pi)
SELECT CAST(floor(c_custkey / 10.0) AS BIGINT) AS chunk_id, COUNT(*) AS total_pis,
  CAST(COALESCE(SUM(n), 0) AS BIGINT) AS total_refs,
  COUNT(*) - COUNT(n) AS pis_without_refs
FROM customer LEFT JOIN n ON pi = c_custkey GROUP BY 1""",
    "skip_enriched": """
SELECT doc_id, doc_id % 5 = 0 AND doc_id % 13 <> 0 AND text <> '' AS skipped,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 13 <> 0 AND text <> '' THEN length(text) END
    AS ocr_text_length
FROM documents""",
    "content_put": """
SELECT DISTINCT sha256(text) AS cid, length(text) AS size FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""",
    "dedup_extract": """
SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS VARCHAR) AS result,
  length(text) AS tokens FROM documents""",
    "reused_results": """
SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS VARCHAR) AS result,
  length(text) AS tokens,
  sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') AS reused
FROM documents""",
    "streaks_by_user": f"""
WITH {STREAKS}
SELECT user_id, event_id, hit = 1 AS rate_limited, CAST(streak AS BIGINT) AS streak,
  CASE WHEN streak > 0 THEN CAST(LEAST(1000 * pow(2.0, LEAST(streak - 1, 5)), 60000.0) AS BIGINT) END
    AS delay_ms
FROM streaks_v""",
    "current_streaks": f"""
WITH {STREAKS}
SELECT user_id, CAST(arg_max(streak, event_id) AS BIGINT) AS streak FROM streaks_v GROUP BY user_id""",
    "attempt_fold": FOLD,
    "stream_attempt_fold": FOLD,
    "backoff_streaks": """
WITH s AS (
  SELECT CAST(floor(event_id / 10.0) AS BIGINT) AS step,
    MAX(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS hit
  FROM events GROUP BY 1),
g AS (SELECT *, SUM(1 - hit) OVER (ORDER BY step) AS grp FROM s),
k AS (SELECT *, SUM(hit) OVER (PARTITION BY grp ORDER BY step) AS streak FROM g),
d AS (SELECT *, LEAST(1000 * pow(2.0, LEAST(streak - 1, 5)), 60000.0) AS delay FROM k),
w AS (
  SELECT *, CASE WHEN streak > 0
    THEN CAST(floor(delay + delay * 0.25 * ((step % 21 - 10) / 10.0) + 0.5) AS BIGINT) END
    AS delay_ms
  FROM d)
SELECT step, hit = 1 AS rate_limited, CAST(0 AS BIGINT) AS chunk_id,
  CAST(streak AS BIGINT) AS streak, delay_ms,
  CASE WHEN delay_ms > 1500 THEN delay_ms - 1500 ELSE 0 END AS remaining_ms,
  COALESCE(delay_ms > 1500, false) AS is_waiting
FROM w""",
    "chunk_fail_fold": f"""
WITH {ATTEMPTS},
f AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY pi, filename ORDER BY ts, event_id) AS n
  FROM attempts_v WHERE message IS NOT NULL),
c AS (
  SELECT pi, filename, COUNT(*) AS total, MAX(CASE WHEN n = 5 THEN message END) AS fifth
  FROM f GROUP BY pi, filename)
SELECT pi, filename, CASE WHEN total >= 5 THEN 'ERROR' END AS phase, fifth AS global_error,
  LEAST(total, 5) AS global_retry_count,
  CASE total WHEN 1 THEN CAST(2000 AS BIGINT) WHEN 2 THEN 4000 WHEN 3 THEN 8000
    WHEN 4 THEN 16000 END AS retry_delay_ms
FROM c""",
    "next_batch": f"""
WITH {REFS}
SELECT * FROM (
  SELECT chunk_id, pi, filename,
    ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY pi, filename) AS rank
  FROM refs_v WHERE status = 'pending') x
WHERE rank <= 5""",
    "claim_batch": f"""
WITH {REFS}
SELECT pi, filename, status, result_cid FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY pi, filename) AS rank
  FROM refs_v WHERE status = 'pending') x
WHERE rank <= 5""",
    "log_tail": """
SELECT * FROM (
  SELECT user_id, event_id,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age
  FROM events) x
WHERE age <= 50""",
    "kept_log": """
SELECT user_id, event_id FROM (
  SELECT user_id, event_id,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age
  FROM events) x
WHERE age <= 100""",
    "entity_tip": f"WITH {TIPS} SELECT entity, tip, ver FROM tips_v",
    "manifest_merge": f"""
WITH {COMPONENTS}
SELECT entity, filename, 'cid' || CAST(partkey AS VARCHAR) AS cid FROM manifest_v""",
    "publish_plan": f"""
WITH {REFS},
p AS (SELECT * FROM refs_v WHERE status IN ('done', 'skipped') AND result_cid IS NOT NULL)
SELECT pi, filename, result_cid, 'OCR: Updated '
  || CAST(COUNT(*) OVER (PARTITION BY pi) AS VARCHAR) || ' refs' AS note
FROM p""",
    "cas_plan": f"""
WITH {UPDATES}
SELECT entity, update_id, committed, round, new_version, new_tip, prev_tip, entity_error
FROM plan_v""",
    "version_append": f"""
WITH {UPDATES}
SELECT entity, new_version AS ver, new_tip AS tip, prev_tip,
  'OCR: Updated ' || CAST(n_components AS VARCHAR) || ' refs' AS note,
  CAST(NULL AS VARCHAR) AS network, n_components
FROM plan_v WHERE committed""",
    "pi_results": f"""
WITH {RESULTS} SELECT pi, chunk_id, status, refs_completed, refs_failed FROM results_v""",
    "chunk_progress": f"""
WITH {REFS}
SELECT batch_id, chunk_id, COUNT(*) AS total_refs,
  COUNT(CASE WHEN status = 'done' THEN 1 END) AS completed,
  COUNT(CASE WHEN status = 'error' THEN 1 END) AS failed,
  COUNT(CASE WHEN status = 'skipped' THEN 1 END) AS skipped,
  COUNT(CASE WHEN status = 'pending' THEN 1 END) AS pending
FROM refs_v GROUP BY batch_id, chunk_id""",
    "failed_refs": f"""
WITH {REFS}
SELECT pi, filename, COALESCE(error, 'Unknown error') AS error FROM refs_v
WHERE status = 'error'""",
    "chunk_report": f"WITH {REPORT} SELECT * FROM report_v",
    "chunk_status": f"""
WITH {PIS}, {REFS}, {CHUNKS},
p AS (
  SELECT batch_id, chunk_id, COUNT(*) AS total_refs,
    COUNT(CASE WHEN status = 'done' THEN 1 END) AS completed,
    COUNT(CASE WHEN status = 'error' THEN 1 END) AS failed,
    COUNT(CASE WHEN status = 'skipped' THEN 1 END) AS skipped,
    COUNT(CASE WHEN status = 'pending' THEN 1 END) AS pending
  FROM refs_v GROUP BY batch_id, chunk_id)
SELECT c.batch_id || ':' || CAST(c.chunk_id AS VARCHAR) AS label,
  CASE phase WHEN 'DONE' THEN 'done' WHEN 'ERROR' THEN 'error' ELSE 'processing' END AS status,
  phase, COALESCE(total_refs, 0) AS total_refs, COALESCE(completed, 0) AS completed,
  COALESCE(failed, 0) AS failed, COALESCE(skipped, 0) AS skipped, COALESCE(pending, 0) AS pending
FROM chunks_v c LEFT JOIN p ON p.batch_id = c.batch_id AND p.chunk_id = c.chunk_id
UNION ALL
SELECT 'none:' || CAST(s_suppkey AS VARCHAR), 'not_found', NULL, NULL, NULL, NULL, NULL, NULL
FROM supplier""",
    "complete_chunks": f"""
WITH {PIS}, {REFS}, {CHUNKS}
SELECT c.batch_id, c.chunk_id, COUNT(r.pi) AS total_refs
FROM chunks_v c LEFT JOIN refs_v r ON r.batch_id = c.batch_id AND r.chunk_id = c.chunk_id
GROUP BY c.batch_id, c.chunk_id HAVING COUNT(CASE WHEN r.status = 'pending' THEN 1 END) = 0""",
    "report_sink": FLAT,
    "batch_rollup": f"""
WITH {REPORT},
s AS (
  SELECT c.batch_id, r.status FROM chunks_v c
  LEFT JOIN report_v r ON r.batch_id = c.batch_id AND r.chunk_id = c.chunk_id
    AND r.chunk_id % 101 <> 100)
SELECT batch_id, COUNT(*) AS n_chunks,
  COUNT(CASE WHEN status IN ('success', 'partial') THEN 1 END) AS n_complete,
  COUNT(CASE WHEN status = 'error' THEN 1 END) AS n_error,
  COUNT(*) = COUNT(status) AS all_ended
FROM s GROUP BY batch_id""",
    "apply_report": f"""
WITH {RESULTS},
n AS (
  SELECT f.pi, r.pi IS NOT NULL AS ocr_complete,
    CASE WHEN r.pi IS NULL THEN 0 ELSE COUNT(CASE WHEN f.status = 'error' THEN 1 END) END
      AS n_errors,
    r.new_tip, r.new_version
  FROM refs_v f LEFT JOIN results_v r ON r.pi = f.pi AND r.chunk_id % 5 <> 0
  GROUP BY f.pi, r.pi, r.new_tip, r.new_version)
SELECT pi, ocr_complete, n_errors,
  CASE WHEN ocr_complete AND pi % 6 = 0 THEN 'aaa'
    WHEN ocr_complete AND pi % 3 = 0 AND COALESCE(new_version, -1) < 0 THEN 'zzz'
    ELSE new_tip END AS new_tip,
  CASE WHEN ocr_complete AND pi % 6 = 0 THEN 9
    WHEN ocr_complete AND pi % 3 = 0 THEN GREATEST(COALESCE(new_version, 0), 0)
    ELSE new_version END AS new_version
FROM n""",
    "cost_rollup": """
SELECT source, COUNT(*) AS n_calls, CAST(SUM(n_chars) AS BIGINT) AS prompt_tokens,
  CAST(SUM(doc_id % 100) AS BIGINT) AS completion_tokens,
  CAST(CAST(SUM(n_chars) * 3 + SUM(doc_id % 100) * 14 AS DECIMAL(38, 0)) / 100000000 AS DOUBLE)
    AS cost_usd
FROM documents GROUP BY source""",
    "assemble_prompts": """
SELECT conv_id, 0 AS piece, 'Directory: ' || CAST(conv_id AS VARCHAR) || ' (depth 1)' AS line
FROM (SELECT DISTINCT conv_id FROM conversations) c
UNION ALL
SELECT conv_id, turn - MIN(turn) OVER (PARTITION BY conv_id) + 1 AS piece,
  '## ' || upper(role) || ': ' || CAST(turn AS VARCHAR) || chr(10) || text AS line
FROM conversations""",
    "extract_pages": f"""
WITH {URLS},
e AS (
  SELECT *, CASE
      WHEN page_id % 4 IN (0, 1) AND page_id % 7 = 0 THEN 'permanent'
      WHEN page_id % 4 IN (0, 1) AND page_id % 15 = 0 THEN 'rate_limit'
      WHEN page_id % 4 = 2 AND page_id % 9 IN (0, 1) THEN 'transient'
      ELSE 'done' END AS outcome,
    page_id % 4 IN (0, 1) AND page_id % 7 <> 0 AND page_id % 3 = 0 AS on_fallback,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
  FROM urls_v)
SELECT page_id, outcome, on_fallback, CASE WHEN outcome = 'done' THEN title END AS text,
  CASE WHEN outcome = 'done' THEN length(title) END AS tokens,
  CASE outcome WHEN 'permanent' THEN 'Permanent OCR failure: Invalid image format'
    WHEN 'rate_limit' THEN 'Rate limited on fallback: 429 Too Many Requests'
    WHEN 'transient' THEN 'OCR failed: 503 upstream timeout' END AS message
FROM e""",
    "enrich_pages": """
WITH k AS (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE
      WHEN page_id % 50 = 49 THEN 'missing' WHEN page_id % 10 = 9 THEN 'old'
      WHEN page_id % 4 IN (0, 1) AND page_id % 7 = 0 THEN 'format'
      WHEN page_id % 4 IN (0, 1) AND page_id % 15 = 0 THEN 'limited'
      WHEN page_id % 4 = 2 AND page_id % 9 = 0 THEN 'timeout'
      WHEN page_id % 4 = 2 AND page_id % 9 = 1 THEN 'once' ELSE 'fine' END AS kind
  FROM pages)
SELECT CAST(page_id AS VARCHAR) AS pi, 'page' || CAST(page_id AS VARCHAR) || '.ref.json' AS filename,
  CASE WHEN kind IN ('missing', 'format', 'timeout') THEN 'error' WHEN kind = 'old' THEN 'skipped'
    ELSE 'done' END AS status,
  CAST(CASE kind WHEN 'limited' THEN 2 WHEN 'timeout' THEN 3 WHEN 'once' THEN 1 ELSE 0 END
    AS BIGINT) AS retry_count,
  CASE kind WHEN 'missing'
      THEN 'Ref data not found for: page' || CAST(page_id AS VARCHAR) || '.ref.json'
    WHEN 'format' THEN 'Permanent OCR failure: Invalid image format'
    WHEN 'timeout' THEN 'Failed after 3 retries: OCR failed: 503 upstream timeout' END AS error,
  CASE WHEN kind = 'old' THEN 8 WHEN kind IN ('limited', 'once', 'fine') THEN length(title) END
    AS ocr_text_length,
  CASE WHEN kind IN ('limited', 'once', 'fine') THEN length(title) END AS tokens,
  CASE WHEN kind = 'old' THEN 'old text' WHEN kind IN ('limited', 'once', 'fine') THEN title END
    AS ocr
FROM k""",
    "call_cost": """
WITH k AS (
  SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE
      WHEN page_id % 50 = 49 OR page_id % 10 = 9 THEN 'none'
      WHEN page_id % 4 IN (0, 1) AND page_id % 7 = 0 THEN 'format'
      WHEN page_id % 4 IN (0, 1) AND page_id % 15 = 0 THEN 'limited'
      WHEN page_id % 4 = 2 AND page_id % 9 = 0 THEN 'timeout'
      WHEN page_id % 4 = 2 AND page_id % 9 = 1 THEN 'once' ELSE 'fine' END AS kind
  FROM pages),
c AS (
  SELECT CAST(CAST(floor(page_id / 10.0) AS BIGINT) AS VARCHAR) AS chunk_id,
    SUM(CASE kind WHEN 'limited' THEN 3 WHEN 'timeout' THEN 3 WHEN 'once' THEN 2 ELSE 1 END)
      AS n_calls,
    SUM(CASE WHEN kind = 'timeout' THEN 0 ELSE length(html) END) AS prompt_tokens,
    SUM(CASE WHEN kind IN ('timeout', 'format') THEN 0 ELSE length(title) END) AS completion_tokens
  FROM k WHERE kind <> 'none' GROUP BY 1)
SELECT chunk_id, CAST(n_calls AS BIGINT) AS n_calls, CAST(prompt_tokens AS BIGINT) AS prompt_tokens,
  CAST(completion_tokens AS BIGINT) AS completion_tokens,
  CAST(CAST(prompt_tokens * 3 + completion_tokens * 14 AS DECIMAL(38, 0)) / 100000000 AS DOUBLE)
    AS cost_usd
FROM c""",
    "process_chunks": PROCESSED,
    "process_resume": PROCESSED,
    "process_failure": f"""
SELECT chunk_id,
  CASE WHEN lost THEN 'error' ELSE status END AS status,
  CASE WHEN lost THEN 0 ELSE total_refs END AS total_refs,
  CASE WHEN lost THEN 0 ELSE completed END AS completed,
  CASE WHEN lost THEN 0 ELSE failed END AS failed,
  CASE WHEN lost THEN 0 ELSE skipped END AS skipped,
  CASE WHEN lost THEN 'lost connection 5' END AS error
FROM (SELECT *, CAST(chunk_id AS BIGINT) % 7 = 3 AND total_refs > 0 AS lost FROM ({PROCESSED}) p) x""",
    "process_rerun": f"""
SELECT chunk_id, status, total_refs, CASE WHEN status = 'success' THEN completed ELSE 0 END AS completed,
  failed, CASE WHEN status = 'success' THEN skipped ELSE completed + skipped END AS skipped,
  CASE WHEN status = 'success' THEN 'w0' ELSE 'w1' END AS run_id,
  CASE WHEN status = 'success' THEN 1 ELSE 2 END AS n_runs
FROM ({PROCESSED}) p""",
    "process_pending": f"""
WITH {FOUND},
s AS (
  SELECT *, CASE WHEN partkey % 5 = 0 THEN 'skipped' WHEN partkey % 3 = 0 THEN 'error'
    WHEN partkey % 7 = 0 THEN 'pending' ELSE 'done' END AS status FROM found_v)
SELECT CAST(CAST(floor(c_custkey / 10.0) AS BIGINT) AS VARCHAR) AS chunk_id, 'processing' AS status,
  COUNT(s.pi) AS total_refs, COUNT(CASE WHEN s.status = 'done' THEN 1 END) AS completed,
  COUNT(CASE WHEN s.status = 'error' THEN 1 END) AS failed,
  COUNT(CASE WHEN s.status = 'skipped' THEN 1 END) AS skipped
FROM customer LEFT JOIN s ON s.pi = c_custkey GROUP BY 1""",
    "process_status": f"""
WITH {FOUND},
s AS (
  SELECT *, CASE WHEN partkey % 5 = 0 THEN 'skipped' WHEN partkey % 3 = 0 THEN 'error'
    WHEN partkey % 7 = 0 THEN 'pending' ELSE 'done' END AS status FROM found_v),
c AS (
  SELECT CAST(floor(c_custkey / 10.0) AS BIGINT) AS chunk_id, COUNT(s.pi) AS total_refs,
    COUNT(CASE WHEN s.status = 'done' THEN 1 END) AS completed,
    COUNT(CASE WHEN s.status = 'error' THEN 1 END) AS failed,
    COUNT(CASE WHEN s.status = 'skipped' THEN 1 END) AS skipped,
    COUNT(CASE WHEN s.status = 'pending' THEN 1 END) AS pending
  FROM customer LEFT JOIN s ON s.pi = c_custkey GROUP BY 1),
k AS (
  SELECT *, total_refs > 0 AND chunk_id % 7 = 3 AS lost,
    CASE WHEN total_refs = 0 THEN 0 WHEN chunk_id % 7 = 3 THEN 5 WHEN chunk_id % 7 = 5 THEN 2 ELSE 0
      END AS failures
  FROM c),
e AS (
  SELECT chunk_id, '1 ' || CAST(pi AS VARCHAR) || '/' || filename || ': ' || CASE status
      WHEN 'error' THEN 'Permanent OCR failure: Invalid image format'
      ELSE 'OCR failed: 503 upstream timeout' END AS line,
    ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY CAST(pi AS VARCHAR) DESC, filename DESC) AS age
  FROM s WHERE status IN ('error', 'pending')),
l AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY age DESC) AS debug_log FROM e
  WHERE age <= 50 GROUP BY chunk_id)
SELECT 'b0' AS batch_id, CAST(k.chunk_id AS VARCHAR) AS chunk_id,
  CASE WHEN lost THEN 'error' ELSE 'processing' END AS status,
  CASE WHEN lost THEN 'ERROR' WHEN pending > 0 THEN 'PROCESSING' ELSE 'PUBLISHING' END AS phase,
  CASE WHEN lost THEN 0 ELSE total_refs END AS total_refs,
  CASE WHEN lost THEN 0 ELSE completed END AS completed,
  CASE WHEN lost THEN 0 ELSE failed END AS failed,
  CASE WHEN lost THEN 0 ELSE skipped END AS skipped,
  CASE WHEN lost THEN 0 ELSE pending END AS pending,
  CAST(failures AS BIGINT) AS failures, CASE WHEN lost THEN 'lost connection 5' END AS error,
  CASE WHEN failures > 0 THEN 'lost connection ' || CAST(failures AS VARCHAR) END AS last_failure,
  CAST(0 AS BIGINT) AS streak, CAST(NULL AS BIGINT) AS delay_ms,
  CASE WHEN NOT lost THEN debug_log END AS debug_log
FROM k LEFT JOIN l ON l.chunk_id = k.chunk_id
UNION ALL
SELECT 'none', CAST(s_suppkey AS VARCHAR), 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, NULL, NULL
FROM supplier""",
    "process_versions": f"""
WITH {PUBLISHED}
SELECT entity, ver, sha256(entity || '|' || CAST(ver AS VARCHAR) || '|b0|' || chunk_id) AS tip,
  prev_tip, 'OCR: Updated ' || CAST(n AS VARCHAR) || ' refs' AS note, n AS n_components
FROM versions_v""",
    "process_components": f"""
WITH {PUBLISHED}
SELECT v.entity, v.ver, s.filename,
  CASE WHEN s.status = 'skipped' THEN s.old_text ELSE 'words of ' || CAST(s.partkey AS VARCHAR) END
    AS ocr
FROM versions_v v JOIN states_v s ON CAST(s.pi AS VARCHAR) = v.entity
WHERE s.status IN ('done', 'skipped')""",
    "stream_complete_chunks": """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS total_refs
FROM events GROUP BY 1, 2
HAVING COUNT(*) = COUNT(CASE WHEN event_type IN ('view', 'purchase') THEN 1 END)""",
    "stream_publish": f"""
WITH {COMPONENTS},
r AS (
  SELECT o_custkey AS entity, o_orderkey AS update_id,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT version_id, COUNT(*) AS n_files FROM components_v WHERE filename LIKE '%.ref.json'
  GROUP BY version_id)
SELECT r.entity, t.ver + r.n AS ver,
  sha256(CAST(r.entity AS VARCHAR) || '|' || CAST(t.ver + r.n AS VARCHAR) || '|'
    || CAST(r.update_id AS VARCHAR)) AS tip,
  COALESCE(f.n_files, 0) AS n_files
FROM r JOIN tips_v t ON t.entity = r.entity LEFT JOIN f ON f.version_id = r.update_id""",
}
