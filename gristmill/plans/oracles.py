"""SQL that gives the same rows as the queries of :mod:`gristmill.plans.catalog`."""

from __future__ import annotations

_FILES = """files AS (
  SELECT CAST(doc_id % 50 AS VARCHAR) AS request_id, doc_id AS arrival_idx, source AS fieldname,
    lang || ' Doc #' || doc_id || '.TXT' AS originalname,
    CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/bmp' WHEN 2 THEN 'application/pdf'
      WHEN 3 THEN 'image/jpeg' ELSE 'text/plain' END AS mimetype,
    CAST(octet_length(encode(text)) AS BIGINT) AS size, text
  FROM documents)"""
_ROUTED = f"""{_FILES},
matched AS (
  SELECT *, CASE WHEN fieldname IN ('src1', 'src0', 'src3') THEN fieldname WHEN fieldname LIKE 'src1%' THEN 'src1*'
    WHEN fieldname LIKE 's%2' THEN 's*2' END AS match_key,
    mimetype LIKE 'image%' AND fieldname <> 'src0' AS converts
  FROM files),
routed AS (
  SELECT *, CASE WHEN match_key = 'src1*' THEN 'cloud' WHEN match_key IN ('src1', 's*2') THEN 'disk' ELSE 'memory' END AS place,
    CASE WHEN converts AND mimetype = 'image/bmp' THEN 'skipped' ELSE
      CASE WHEN match_key = 'src1*' THEN 'cloud' WHEN match_key IN ('src1', 's*2') THEN 'disk' ELSE 'memory' END
      || CASE WHEN converts THEN '_convert' ELSE '_passthrough' END END AS route
  FROM matched WHERE match_key IS NOT NULL)"""
_SLUG = "regexp_replace(regexp_replace(lower(lang || ' Doc #' || doc_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_BASE = "regexp_extract(url, '([^/]*)/*$', 1)"
_MIXED = f"""{_FILES},
placed AS (
  SELECT *, CASE WHEN fieldname LIKE 'src1%' THEN 'cloud' WHEN fieldname LIKE 's%2' THEN 'disk' ELSE 'memory' END AS place,
    mimetype LIKE 'image%' AND (fieldname = 'src0' OR fieldname LIKE 'src1%' OR fieldname LIKE 's%2') AS converts
  FROM files),
ended AS (
  SELECT *, converts AND mimetype = 'image/bmp' AS skipped, converts AND mimetype <> 'image/bmp' AND text LIKE 'E%' AS fell,
    converts AND mimetype <> 'image/bmp' AND text NOT LIKE 'E%' AS ok
  FROM placed)"""

SQL: dict[str, str] = {
    "route_summary": f"""WITH {_ROUTED}
SELECT match_key, route, CASE WHEN size > 4096 THEN 'disk' ELSE 'memory' END AS backup_tier, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes
FROM routed GROUP BY ALL""",
    "generated_names": f"""WITH named AS (
  SELECT doc_id AS arrival_idx, {_SLUG} AS slug,
    CASE WHEN doc_id % 5 IN (0, 1, 3) THEN source || '-' ELSE '' END || {_SLUG} || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS stem
  FROM documents)
SELECT arrival_idx, slug, stem || '.txt' AS generated, stem || '.webp' AS converted, 'image/webp' AS mimetype FROM named""",
    "group_by_field": f"""WITH {_FILES}
SELECT request_id, fieldname, count(*) AS n_files, string_agg(originalname, '|' ORDER BY arrival_idx) AS names, CAST(sum(size) AS BIGINT) AS n_bytes
FROM files GROUP BY ALL""",
    "wildcard_match": """SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN event_type WHEN event_type LIKE 'pur%' THEN 'pur*'
  WHEN event_type LIKE '%i%' THEN '*i*' END AS match_key, count(*) AS n FROM events GROUP BY ALL""",
    "allow_list_filter": "SELECT event_id, event_type FROM events WHERE event_type = 'click' OR event_type LIKE 'pur%'",
    "default_config_lookup": """SELECT event_type, CASE event_type WHEN 'pur*' THEN 'disk' ELSE 'memory' END AS output,
  CASE event_type WHEN 'click' THEN 'png' ELSE 'webp' END AS format, CAST(CASE event_type WHEN 'click' THEN 60 ELSE 80 END AS DOUBLE) AS quality,
  event_type = 'view' AS keep_original, count(*) AS n FROM events GROUP BY ALL""",
    "size_limit_reject": """WITH t AS (SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM conversations)
SELECT conv_id, turn, size FROM t QUALIFY coalesce(max(size) OVER (PARTITION BY conv_id), 0) <= 600""",
    "rejected_requests": """SELECT conv_id, max(CAST(octet_length(encode(text)) AS BIGINT)) AS largest
FROM conversations GROUP BY conv_id HAVING largest > 600""",
    "spill_tier": f"WITH {_FILES} SELECT arrival_idx, size, CASE WHEN size > 4096 THEN 'disk' ELSE 'memory' END AS tier FROM files",
    "savings_metric": f"""WITH {_FILES},
sizes AS (SELECT arrival_idx, size AS original, CAST(floor(size * 7 / 10) AS BIGINT) - 100 AS converted FROM files)
SELECT arrival_idx, CASE WHEN original <> 0 THEN round(1 - CAST(converted AS DOUBLE) / original, 6) END AS ratio,
  CASE WHEN original > 0 AND converted >= 0 THEN round(1 - CAST(converted AS DOUBLE) / original, 6) END AS guarded FROM sizes""",
    "cloud_urls": """SELECT page_id,
  CASE WHEN page_id % 3 = 0 THEN 'https://cdn.example.com' ELSE 'https://corpus.s3.eu-west-1.amazonaws.com' END || '/page-' || page_id || '.html' AS s3,
  CASE WHEN page_id % 3 = 0 THEN 'https://cdn.example.com' ELSE 'https://storage.googleapis.com/corpus' END || '/page-' || page_id || '.html' AS gcs
FROM pages""",
    "resource_type": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '([^.]*)$', 1)) AS ext FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'raw' ELSE
    CASE WHEN ext <> '' AND ext NOT IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'svg', 'mp4', 'mov', 'avi') THEN 'raw' ELSE 'auto' END END AS by_url,
  CASE page_id % 4 WHEN 1 THEN 'raw' WHEN 3 THEN 'raw' ELSE 'auto' END AS by_name
FROM p""",
    "path_parse": rf"""WITH p AS (SELECT page_id, {_BASE} AS base FROM pages),
e AS (SELECT *, CASE WHEN base = '..' THEN '' ELSE regexp_extract(base, '^.+(\.[^.]*)$', 1) END AS ext FROM p)
SELECT page_id, base, substr(base, 1, length(base) - length(ext)) AS stem, ext FROM e""",
    "outcome_matrix": f"""WITH {_ROUTED},
played AS (
  SELECT *, route LIKE '%_convert' AND arrival_idx % 3 = 0 AS bad, route <> 'skipped' AND place <> 'memory' AND arrival_idx % 4 = 0 AS lost,
    route LIKE '%_convert' AND place <> 'memory' AND arrival_idx % 6 = 0 AS lost_backup
  FROM routed),
ended AS (
  SELECT *, CASE WHEN route = 'skipped' THEN 'skipped' WHEN bad AND size > 0 AND NOT lost_backup THEN 'fallback' WHEN bad OR lost THEN 'skipped'
    WHEN route LIKE '%_convert' THEN 'converted' ELSE 'stored' END AS outcome
  FROM played),
told AS (
  SELECT *, CASE WHEN route = 'skipped' THEN 'message'
    WHEN outcome = 'fallback' THEN CASE place WHEN 'disk' THEN 'pipeline' ELSE 'conversion' END
    WHEN bad AND lost_backup THEN CASE place WHEN 'disk' THEN 'pipeline,fallback,message' ELSE 'conversion,cloudUpload,message' END
    WHEN bad THEN CASE place WHEN 'disk' THEN 'pipeline,message' ELSE 'conversion,message' END
    WHEN lost THEN CASE place WHEN 'disk' THEN 'diskWrite,message' ELSE 'cloudUpload,message' END ELSE '' END AS errors,
    CASE WHEN outcome = 'converted' THEN least(size, 100) END AS now
  FROM ended)
SELECT route, outcome,
  CASE outcome WHEN 'fallback' THEN true WHEN 'skipped' THEN false END AS "isBackupFallback",
  CASE outcome WHEN 'fallback' THEN false WHEN 'skipped' THEN true END AS "isSkipped",
  CASE outcome WHEN 'fallback' THEN true WHEN 'skipped' THEN false END AS "isProcessed",
  errors, count(*) AS n,
  CAST(sum(CASE WHEN outcome = 'converted' AND place = 'memory' THEN now
    WHEN outcome = 'stored' OR outcome = 'fallback' AND place <> 'cloud' THEN size END) AS BIGINT) AS "sum_result_size",
  CAST(sum(CASE WHEN outcome = 'converted' OR outcome = 'fallback' AND place <> 'cloud' THEN size END) AS BIGINT) AS "sum_originalSize",
  CAST(sum(CASE WHEN outcome = 'converted' AND place <> 'memory' THEN now END) AS BIGINT) AS "sum_convertedSize"
FROM told GROUP BY ALL""",
    "convert_run": f"""WITH {_FILES},
f AS (
  SELECT *, mimetype LIKE 'image%' AND fieldname <> 'src0' AS converts, text LIKE 'E%' AS refused,
    CASE WHEN fieldname = 'src1' THEN 50 ELSE 80 END AS quality
  FROM files),
e AS (SELECT *, converts AND NOT refused AS ok, converts AND refused AS fell FROM f)
SELECT arrival_idx, CASE WHEN ok THEN 'converted' WHEN fell THEN 'fallback' ELSE 'unchanged' END AS outcome,
  CASE WHEN NOT ok THEN mimetype WHEN fieldname = 'src1' THEN 'image/png' ELSE 'image/webp' END AS mimetype,
  CASE WHEN ok THEN size * quality // 100 ELSE size END AS size,
  CASE WHEN converts THEN size END AS "originalSize",
  CASE WHEN ok THEN size * quality // 100 WHEN fell THEN size END AS "convertedSize",
  CASE WHEN fell THEN 'begins with E' END AS conversion,
  CASE WHEN ok THEN size * quality // 100 ELSE size END AS n_buffer
FROM e""",
    "sink_commit": f"""WITH {_FILES}
SELECT arrival_idx, 'stored' AS outcome, size, size AS stored_size, md5(text) AS md5 FROM files""",
    "cloud_upload": f"""WITH {_FILES}
SELECT arrival_idx, 'stored' AS outcome, CASE WHEN fieldname LIKE 'src1%' THEN 'src1*' ELSE '*' END AS match_key,
  'emulator' AS "cloudProvider", 'corpus' AS "cloudBucket", size AS "cloudSize", md5(text) AS "cloudETag"
FROM files""",
    "transcode": """WITH p AS (SELECT doc_id, md5(text || repeat(' ', (64 - octet_length(encode(text)) % 64) % 64)) AS m FROM documents)
SELECT doc_id, m AS png, m AS tiff, m AS gif, true AS jpeg_is_close FROM p""",
    "convert_and_store": f"""WITH {_MIXED}
SELECT arrival_idx, CASE WHEN skipped THEN 'skipped' ELSE place || CASE WHEN converts THEN '_convert' ELSE '_passthrough' END END AS route,
  CASE WHEN skipped THEN 'skipped' WHEN fell THEN 'fallback' WHEN ok THEN 'converted' ELSE 'stored' END AS outcome,
  CASE WHEN NOT ok THEN mimetype WHEN place = 'disk' THEN 'image/tiff' ELSE 'image/png' END AS mimetype,
  CASE WHEN skipped OR fell AND place = 'cloud' OR ok AND place <> 'memory' THEN NULL WHEN ok THEN size + 4 ELSE size END AS size,
  CASE WHEN ok OR fell AND place <> 'cloud' THEN size END AS original_size,
  CASE WHEN ok AND place <> 'memory' THEN size + 4 END AS converted_size,
  CASE WHEN place = 'cloud' AND NOT skipped THEN CASE WHEN ok THEN size + 4 ELSE size END END AS cloud_size,
  CASE WHEN place = 'cloud' AND NOT skipped THEN md5(CASE WHEN ok THEN 'NEW:' || text ELSE text END) END AS cloud_md5,
  CASE WHEN place = 'cloud' AND NOT skipped THEN CASE WHEN ok THEN 'image/png' ELSE mimetype END END AS cloud_type,
  CASE WHEN skipped THEN NULL WHEN place = 'cloud' THEN 2 WHEN place = 'disk' THEN 1 END AS attempts,
  CASE WHEN place = 'disk' AND NOT skipped THEN md5(CASE WHEN ok THEN 'NEW:' || text ELSE text END) END AS disk_md5,
  CASE WHEN place = 'memory' AND NOT skipped THEN md5(CASE WHEN ok THEN 'NEW:' || text ELSE text END) END AS memory_md5,
  fell
FROM ended""",
    "log_events": f"""WITH {_MIXED},
lines AS (
  SELECT 'info' AS level, 'uploaded' AS kind FROM ended WHERE place = 'cloud' AND NOT skipped
  UNION ALL SELECT 'warning', 'tried' FROM ended WHERE place = 'cloud' AND NOT skipped
  UNION ALL SELECT 'warning', 'kept' FROM ended WHERE fell
  UNION ALL SELECT 'error', 'skipped' FROM ended WHERE skipped)
SELECT level, kind, count(*) AS n FROM lines GROUP BY ALL""",
    "ingest_limit": f"""WITH {_FILES},
r AS (SELECT arrival_idx, CAST(arrival_idx // 3 AS VARCHAR) AS request_id, size, max(size) OVER (PARTITION BY arrival_idx // 3) > 8000 AS bad FROM files)
SELECT arrival_idx, request_id, CASE WHEN bad THEN 'rejected' ELSE 'stored' END AS outcome, CASE WHEN NOT bad THEN size END AS size, NOT bad AS kept, bad AS told FROM r""",
    "disk_conversion": f"""WITH {_FILES},
e AS (
  SELECT *, fieldname IN ('src1', 'src2') AS disk, mimetype LIKE 'image%' AND text LIKE 'E%' AS fell, mimetype LIKE 'image%' AND text NOT LIKE 'E%' AS ok
  FROM files)
SELECT arrival_idx, CASE WHEN ok THEN 'converted' WHEN fell THEN 'fallback' ELSE 'unchanged' END AS outcome,
  CASE WHEN disk AND (ok OR fell) THEN CASE fieldname WHEN 'src1' THEN 'two' ELSE 'uploads' END END AS folder,
  CASE WHEN NOT ok THEN mimetype WHEN disk THEN 'image/png' ELSE 'image/webp' END AS mimetype,
  CASE WHEN ok THEN size + 4 ELSE size END AS size, CASE WHEN ok THEN size + 4 WHEN fell THEN size END AS converted_size,
  CASE WHEN disk AND (ok OR fell) THEN md5(CASE WHEN ok THEN 'NEW:' || text ELSE text END) END AS disk_md5,
  CASE WHEN NOT disk OR NOT (ok OR fell) THEN md5(CASE WHEN ok THEN 'NEW:' || text ELSE text END) END AS memory_md5
FROM e""",
    "unreadable_images": f"""WITH {_FILES}
SELECT arrival_idx, CASE WHEN mimetype = 'image/bmp' THEN 'skipped' WHEN mimetype LIKE 'image%' THEN 'fallback' ELSE 'stored' END AS outcome, mimetype,
  CASE WHEN mimetype LIKE 'image%' AND mimetype <> 'image/bmp' THEN 'input buffer contains an image format that is not supported' END AS conversion,
  CASE WHEN mimetype = 'image/bmp' THEN 'unsupported image format image/bmp' END AS message
FROM files""",
    "discard_stored": "SELECT doc_id AS arrival_idx, doc_id % 2 <> 0 AS there FROM documents",
    "landing_read": f"""WITH {_FILES}
SELECT 'r ' || request_id AS request_id, fieldname, arrival_idx || '.TXT' AS originalname, 'text/plain' AS mimetype,
  CASE WHEN arrival_idx % 7 = 0 THEN 0 ELSE size END AS size, md5(CASE WHEN arrival_idx % 7 = 0 THEN '' ELSE text END) AS md5
FROM files""",
    "buffer_records": f"""WITH {_FILES}
SELECT form, request_id, arrival_idx, fieldname, originalname, mimetype, size FROM files CROSS JOIN (VALUES ('list'), ('map')) f(form)""",
    "streaming_ingest": """SELECT 'req' AS request_id, 'field' || item_id % 3 AS fieldname, 'stored' AS outcome, 'text/plain' AS mimetype,
  count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
FROM benchmark WHERE item_id % 3 < 2 GROUP BY ALL""",
}
