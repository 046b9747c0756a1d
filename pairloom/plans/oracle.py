"""The reference queries in DuckDB's SQL."""

from __future__ import annotations

from pairloom.operators.lookup import OUTPUT_FOLDERS
from pairloom.sources.derived import NAMES

MEDIA_FILES = """
files AS (
  SELECT ordinal, file_name, size_bytes, mtime FROM (
    SELECT o_orderkey AS ordinal,
      (CASE WHEN o_orderkey % 2 = 0 THEN 'IMG_' ELSE 'img_' END) || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ||
      (CASE o_orderkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.mov' WHEN 3 THEN '.MP4' ELSE '.png' END) AS file_name,
      CAST(floor(o_totalprice) AS BIGINT) * (CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 1 END) AS size_bytes, o_orderdate AS mtime
    FROM orders)
  QUALIFY row_number() OVER (PARTITION BY lower(file_name) ORDER BY ordinal) = 1)"""

SIDES = MEDIA_FILES + """,
named AS (SELECT *, regexp_replace(file_name, '[.][^.]*$', '') AS base FROM files),
image AS (
  SELECT lower(base) AS key, arg_max(file_name, ordinal) AS image_name, arg_max(size_bytes, ordinal) AS image_size,
    arg_min(base, ordinal) AS base_name, min(ordinal) AS first_ordinal
  FROM named WHERE lower(file_name) LIKE '%.jpg' OR lower(file_name) LIKE '%.jpeg' GROUP BY 1),
video AS (
  SELECT lower(base) AS key, arg_max(file_name, ordinal) AS video_name, arg_max(size_bytes, ordinal) AS video_size
  FROM named WHERE lower(file_name) LIKE '%.mov' OR lower(file_name) LIKE '%.mp4' GROUP BY 1),
pairs AS (SELECT base_name, image_name, video_name, image_size, video_size, first_ordinal FROM image JOIN video USING (key))"""


def kb_or_mb(size: str) -> str:
    kb, mb = f"(({size}) * 20 + 1024) // 2048", f"(({size}) * 200 + 1048576) // 2097152"
    return f"""CASE WHEN ({size}) < 1048576 THEN CAST(({kb}) // 10 AS VARCHAR) || '.' || CAST(({kb}) % 10 AS VARCHAR) || ' KB'
      ELSE CAST(({mb}) // 100 AS VARCHAR) || '.' || lpad(CAST(({mb}) % 100 AS VARCHAR), 2, '0') || ' MB' END"""


def byte_size(size: str) -> str:
    out = f"CASE WHEN ({size}) IS NULL OR ({size}) < 0 THEN '(unknown)'"
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        s = 1024**power
        hundredths = f"((CAST({size} AS HUGEINT) * 200 + {s}) // {2 * s})"
        text = f"CAST({hundredths} // 100 AS VARCHAR) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0') || ' {unit}'"
        out += f" ELSE {text} END" if unit == "TB" else f" WHEN ({size}) < {1024 ** (power + 1)} THEN {text}"
    return out


HEADS = """
heads AS (
  SELECT doc_id AS ordinal, n_chars, CAST(n_chars + CASE WHEN doc_id % 9 = 0 THEN 5000 ELSE 100 END AS VARCHAR) AS len,
    CASE doc_id % 4 WHEN 0 THEN 'video/quicktime' WHEN 1 THEN ' Video/MP4 ' ELSE 'other' END AS mime,
    (CASE doc_id % 7 WHEN 0 THEN 'MVIMG_' WHEN 1 THEN '_pic' ELSE 'Pic' END) || CAST(doc_id AS VARCHAR) ||
    (CASE doc_id % 11 WHEN 0 THEN '.MP.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.JPEG' ELSE '.jpg' END) AS file_name,
    CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars + 1000 END AS size_bytes,
    '0000' || (CASE WHEN doc_id % 6 < 4 THEN 'ftyp' WHEN doc_id % 6 = 4 THEN 'moov' ELSE 'free' END) ||
    (CASE WHEN doc_id % 8 < 2 THEN 'qt  ' WHEN doc_id % 8 < 4 THEN 'isom' WHEN doc_id % 8 = 4 THEN 'MP42' WHEN doc_id % 8 = 5 THEN 'hev1' ELSE 'heic' END) AS long_header,
    CASE WHEN doc_id % 3 = 0 THEN '/IN' ELSE '/out' END AS output_dir
  FROM documents),
media AS (
  SELECT *, CASE ordinal % 5
      WHEN 0 THEN '<x GCamera:MicroVideoOffset="' || len || '"/>'
      WHEN 1 THEN '<i Item:Semantic="MotionPhoto" Item:Mime="' || mime || '" Item:Length="' || len || '"/>'
      WHEN 2 THEN '<i item:length="' || len || '"' || chr(10) || ' item:mime="' || mime || '" item:semantic="motionphoto"/>'
      WHEN 3 THEN '<x GCamera:MicroVideoOffset="99999999999999999999"/><i Item:Length="' || len || '" Item:Semantic="MotionPhoto"/>'
      ELSE '<x gcamera:microvideo/>' END AS metadata,
    CASE WHEN ordinal % 10 = 0 THEN substr(long_header, 1, 8) ELSE long_header END AS header
  FROM heads),
lengths AS (
  SELECT *, coalesce(
      TRY_CAST(nullif(regexp_extract(metadata, 'GCamera:MicroVideoOffset="([0-9]+)"', 1, 'i'), '') AS BIGINT),
      TRY_CAST(nullif(coalesce(nullif(regexp_extract(metadata, 'Item:Semantic="MotionPhoto"[^>]*Item:Length="([0-9]+)"', 1, 'is'), ''),
        regexp_extract(metadata, 'Item:Length="([0-9]+)"[^>]*Item:Semantic="MotionPhoto"', 1, 'is')), '') AS BIGINT)) AS video_length,
    lower(trim(coalesce(nullif(regexp_extract(metadata, 'Item:Semantic="MotionPhoto"[^>]*Item:Mime="([^"]+)"', 1, 'is'), ''),
      regexp_extract(metadata, 'Item:Mime="([^"]+)"[^>]*Item:Semantic="MotionPhoto"', 1, 'is')))) AS mime_type,
    substr(header, 5, 4) AS box, lower(substr(header, 9, 4)) AS brand
  FROM media),
kinds AS (
  SELECT *, CASE
      WHEN length(header) >= 12 AND box = 'ftyp' AND starts_with(brand, 'qt') THEN '.mov'
      WHEN length(header) >= 12 AND box = 'ftyp' AND (starts_with(brand, 'isom') OR starts_with(brand, 'mp4') OR starts_with(brand, 'avc1') OR starts_with(brand, 'hvc1') OR starts_with(brand, 'hev1')) THEN '.mp4'
      WHEN length(header) >= 12 AND box = 'moov' THEN '.mov'
      WHEN mime_type = 'video/quicktime' THEN '.mov' ELSE '.mp4' END AS detected
  FROM lengths),
candidates AS (
  SELECT *, CASE
      WHEN starts_with(lower(file_name), 'mvimg_') OR lower(file_name) LIKE '%.mp.jpg' OR lower(file_name) LIKE '%.mp.jpeg' THEN true
      WHEN size_bytes <= 0 THEN false
      ELSE contains(metadata, 'GCamera:MicroVideo') OR contains(metadata, 'MicroVideoOffset') OR contains(metadata, 'Container:Directory') OR contains(metadata, 'MotionPhoto') END AS recognised
  FROM media WHERE lower(file_name) LIKE '%.jpg' OR lower(file_name) LIKE '%.jpeg')"""

EXIF = """
exif AS (
  SELECT p_partkey AS ordinal,
    'p' || CAST(p_partkey AS VARCHAR) || (CASE p_partkey % 10 WHEN 0 THEN '.heic' WHEN 1 THEN '.png' ELSE '.JPG' END) AS file_name,
    CASE WHEN p_partkey % 2 = 0 THEN '/out' ELSE ' ' END AS output_dir,
    p_partkey % 97 = 5 OR p_partkey % 97 = 6 AS broken,
    CASE WHEN p_partkey % 3 = 0 THEN p_size + 10 ELSE p_size END AS w, CASE WHEN p_partkey % 3 = 1 THEN p_size + 10 ELSE p_size END AS h,
    CASE p_partkey % 4 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 270 ELSE 0 END AS angle,
    (p_partkey // 12) % 2 = 0 AS thumb
  FROM part),
issues AS (
  SELECT *, CASE WHEN broken THEN 'Error'
      WHEN NOT (w > h OR (w < h AND angle > 0) OR thumb) THEN 'Perfect'
      WHEN w > h OR angle > 0 THEN 'NeedsRebuild' ELSE 'NeedsStrip' END AS issue_type
  FROM exif),
analysed AS (
  SELECT *, issue_type IN ('NeedsRebuild', 'NeedsStrip') AS needs_repair,
    CASE WHEN issue_type IN ('Error', 'Perfect') THEN 0 ELSE angle END AS rotation_angle
  FROM issues)"""


def described(words: dict[str, str], wrapped: bool) -> str:
    first = f"CASE WHEN w > h THEN '[{words['wide']}]' WHEN w < h AND angle > 0 THEN '[{words['tall']}]' END"
    turned = f"replace('[{words['angle']}]', '{{0}}', CAST(angle AS VARCHAR))"
    second = f"CASE WHEN w > h AND angle = 0 THEN '[{words['no_angle']}]' WHEN w > h OR (w < h AND angle > 0) THEN {turned} END"
    third = f"CASE WHEN thumb THEN '[{words['thumb']}]' END"
    pair = f"concat_ws(' ', {first}, {second})"
    text = f"concat_ws(chr(10), nullif({pair}, ''), {third})" if wrapped else f"concat_ws(' ', {first}, {second}, {third})"
    return f"CASE issue_type WHEN 'Error' THEN '' WHEN 'Perfect' THEN '[{words['perfect']}]' ELSE {text} END"


ARTIFACTS = """
found AS (
  SELECT event_id AS ordinal, ts AS mtime, CASE event_type WHEN 'error' THEN 'log' WHEN 'click' THEN 'dump' ELSE 'recovered' END AS kind,
    CASE event_type WHEN 'error' THEN 'crash-' || CAST(event_id AS VARCHAR) || '.log' WHEN 'click' THEN 'app.' || CAST(event_id AS VARCHAR) || '.DMP'
      ELSE 'Crash-' || CAST(event_id AS VARCHAR) || '-Recovered.LOG' END AS file_name
  FROM events WHERE event_type IN ('error', 'click', 'view')),
newest AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY kind ORDER BY mtime DESC, ordinal DESC) = 1)"""

TASKS = """
tasks AS (
  SELECT o_orderkey + 1 AS idx, 'IMG_' || repeat('long', CAST(o_orderkey % 12 AS INT)) || CAST(o_orderkey AS VARCHAR) || '.MP.jpg' AS file_name,
    CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'P' THEN 'Success' ELSE 'Pending' END AS status,
    o_orderkey % 3 <> 0 AS needs_repair, o_orderkey % 4 = 0 AS has_thumbnail,
    CASE o_orderkey % 6 WHEN 0 THEN 'Skipped' WHEN 1 THEN '[No repair needed]' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE 'done ' || CAST(o_orderkey AS VARCHAR) END AS details
  FROM orders),
totals AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'Success') AS done FROM tasks)"""

SHOWN = "CAST({done} AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS progress_text, CAST(100 AS DOUBLE) * ({done}) / CAST(n AS DOUBLE) AS progress"

EN = {"wide": "Horizontally stretched", "tall": "Vertically stretched", "angle": "With {0}° rotation label", "no_angle": "Missing rotation label", "thumb": "Extra thumbnail", "perfect": "No repair needed"}
ZH = {"wide": "像素横向拉伸", "tall": "像素纵向拉伸", "angle": "带 {0}° 旋转标签", "no_angle": "缺失旋转标签", "thumb": "多余缩略图", "perfect": "无需修复"}


def shortened(head: int) -> str:
    return f"CASE WHEN length(base) <= 30 THEN file_name ELSE left(base, {head}) || '...' || right(base, 8) || ext END"


def output(suffix: str, ext: str) -> str:
    plain = f"output_dir || '/' || base || {ext}"
    return f"CASE WHEN lower({plain}) = lower('/in/' || file_name) THEN output_dir || '/' || base || '{suffix}' || {ext} ELSE {plain} END"


def around(centre: int, forward: bool) -> str:
    low, high = (centre - 5, centre + 10) if forward else (centre - 10, centre + 5)
    return f"""SELECT {centre} AS centre, {str(forward).lower()} AS forward, idx, file_name FROM tasks
      WHERE idx - 1 BETWEEN {low} AND {high} AND idx - 1 <> {centre} AND NOT has_thumbnail"""


ELAPSED = "CAST(floor(value * 1000 + user_id * 86000) AS BIGINT)"

SQL: dict[str, str] = {
    "pair_scan": f"WITH {SIDES} SELECT *, row_number() OVER (ORDER BY first_ordinal) AS idx FROM pairs",
    "pair_counts": f"""WITH {SIDES} SELECT count(*) FILTER (WHERE image_name IS NOT NULL AND video_name IS NOT NULL) AS pairs,
      count(*) FILTER (WHERE video_name IS NULL) AS lone_images, count(*) FILTER (WHERE image_name IS NULL) AS lone_videos
      FROM image FULL JOIN video USING (key)""",
    "merge_tasks": f"""WITH {SIDES} SELECT row_number() OVER (ORDER BY first_ordinal) AS idx, base_name, image_name, video_name,
      {kb_or_mb('image_size')} AS image_size_text, {kb_or_mb('video_size')} AS video_size_text,
      image_size + video_size AS total_size_bytes, 'Pending' AS status FROM pairs""",
    "size_format": f"""WITH {MEDIA_FILES}, sized AS (SELECT ordinal, size_bytes, size_bytes * CASE ordinal % 7 WHEN 0 THEN -1 WHEN 1 THEN 1000 ELSE 1 END AS big FROM files)
      SELECT ordinal, {kb_or_mb('size_bytes')} AS short_text, {byte_size('big')} AS long_text FROM sized""",
    "name_truncate": f"""WITH {TASKS}, parts AS (SELECT idx, file_name, regexp_replace(file_name, '[.][^.]*$', '') AS base, regexp_extract(file_name, '([.][^.]*)$', 1) AS ext FROM tasks)
      SELECT idx, base, ext, {shortened(22)} AS merge_name, {shortened(21)} AS repair_name FROM parts""",
    "recognise_scan": f"""WITH {HEADS} SELECT row_number() OVER (ORDER BY upper(file_name), ordinal) AS idx, file_name, {kb_or_mb('size_bytes')} AS size_text,
      '0%' AS progress_text, 'Pending' AS status FROM candidates WHERE recognised""",
    "recognise_counts": f"WITH {HEADS} SELECT count(*) FILTER (WHERE recognised) AS recognised, count(*) FILTER (WHERE NOT recognised) AS skipped FROM candidates",
    "split_length": f"WITH {HEADS} SELECT ordinal, video_length FROM lengths",
    "video_extension": f"WITH {HEADS} SELECT ordinal, detected, '.mp4' AS as_mp4, '.mov' AS as_mov FROM kinds",
    "split_plan": f"""WITH {HEADS}, parts AS (
        SELECT *, regexp_replace(file_name, '[.][^.]*$', '') AS base, regexp_extract(file_name, '([.][^.]*)$', 1) AS ext,
          CASE WHEN size_bytes <= 0 THEN 'empty' WHEN video_length IS NULL THEN 'no_metadata'
            WHEN video_length <= 0 OR size_bytes - video_length <= 0 THEN 'bad_length' ELSE 'ok' END AS status FROM kinds)
      SELECT ordinal, file_name, status, CASE WHEN status = 'ok' THEN size_bytes - video_length END AS image_length,
        CASE WHEN status = 'ok' THEN video_length END AS video_length,
        CASE WHEN status = 'ok' THEN {output('_image', "CASE WHEN ext = '' THEN '.jpg' ELSE ext END")} END AS image_output,
        CASE WHEN status = 'ok' THEN {output('_video', 'detected')} END AS video_output FROM parts""",
    "repair_classify": f"WITH {EXIF} SELECT ordinal, issue_type, rotation_angle, needs_repair, {described(EN, False)} AS issue_description FROM analysed",
    "repair_tags_wrapped": f"WITH {EXIF} SELECT ordinal, {described(ZH, True)} AS issue_description FROM analysed",
    "repair_counts": f"""WITH {EXIF} SELECT count(*) AS total, count(*) FILTER (WHERE needs_repair) AS broken, count(*) FILTER (WHERE NOT needs_repair) AS normal
      FROM analysed WHERE file_name NOT LIKE '%.png'""",
    "repair_plan": f"""WITH {EXIF}, plan AS (SELECT *, '/in/' || file_name AS source, CASE WHEN output_dir = ' ' THEN '/in/' || file_name ELSE output_dir || '/' || file_name END AS target FROM analysed WHERE needs_repair)
      SELECT ordinal, target, CASE WHEN issue_type = 'NeedsRebuild' THEN
          'rotate ' || CAST(rotation_angle AS VARCHAR) || ' ' || source || ' ' || target || '.tmp_repair; copy_tags ' || source || ' ' || target ||
          '.tmp_repair; drop ThumbnailImage Orientation ' || target || '.tmp_repair; move ' || target || '.tmp_repair ' || target
        ELSE 'copy ' || source || ' ' || target || '.tmp_repair; drop ThumbnailImage ' || target || '.tmp_repair; move ' || target || '.tmp_repair ' || target END AS commands FROM plan""",
    "repair_tasks": f"""WITH {EXIF} SELECT ordinal, file_name, 'Pending' AS status, needs_repair,
      CASE WHEN needs_repair THEN 'Waiting for repair' ELSE 'Skipped' END AS details FROM analysed WHERE file_name NOT LIKE '%.png'""",
    "pending_filter": f"""WITH {TASKS} SELECT idx, 'run' AS kind FROM tasks WHERE status <> 'Success'
      UNION ALL SELECT idx, 'repair' AS kind FROM tasks WHERE needs_repair AND status <> 'Success'""",
    "progress_split": f"""WITH {TASKS}, run AS (SELECT idx, row_number() OVER (ORDER BY idx) AS nth FROM tasks WHERE status <> 'Success')
      SELECT idx, {SHOWN.format(done='nth + done')} FROM run, totals""",
    "progress_merge": f"""WITH {TASKS}, run AS (SELECT idx, row_number() OVER (ORDER BY idx) AS nth FROM tasks WHERE status <> 'Success')
      SELECT idx, {SHOWN.format(done='nth')} FROM run, totals""",
    "progress_repair": f"""WITH {TASKS}, run AS (SELECT *, row_number() OVER (ORDER BY idx) AS nth FROM tasks)
      SELECT idx, {SHOWN.format(done='nth')} FROM run, totals WHERE needs_repair AND status <> 'Success'""",
    "display_status": f"""WITH {TASKS} SELECT idx, CASE WHEN trim(coalesce(details, '')) <> '' THEN details
        ELSE CASE status WHEN 'Pending' THEN 'Waiting' WHEN 'Success' THEN 'Done' ELSE 'Failed' END END AS split_text,
      CASE WHEN contains(coalesce(details, ''), 'Skipped') OR contains(coalesce(details, ''), 'No repair needed') THEN 'Success' ELSE status END AS repair_status,
      CASE status WHEN 'Success' THEN '255,16,185,129' WHEN 'Failed' THEN '255,239,68,68' ELSE 'default' END AS colour FROM tasks""",
    "applied_results": f"""WITH {TASKS}, ran AS (SELECT *, status <> 'Success' AND idx % 2 = 0 AS due FROM tasks)
      SELECT idx, CASE WHEN due THEN CASE WHEN idx % 4 = 0 THEN 'Success' ELSE 'Failed' END ELSE status END AS status,
        CASE WHEN due THEN CASE WHEN idx % 4 = 0 THEN '100%' ELSE '0%' END WHEN status = 'Success' THEN '100%' ELSE '0%' END AS progress_text,
        CASE WHEN due THEN 'm' || CAST(idx AS VARCHAR) ELSE '' END AS details FROM ran""",
    "prefetch_window": f"WITH {TASKS} " + " UNION ALL ".join(around(c, f) for c, f in ((0, True), (700, True), (700, False), (1498, True))),
    "latest_artifact": f"""WITH {ARTIFACTS} SELECT kind, file_name FROM newest
      ORDER BY mtime DESC, CASE kind WHEN 'log' THEN 0 WHEN 'dump' THEN 1 ELSE 2 END LIMIT 1""",
    "latest_of_kinds": f"WITH {ARTIFACTS} SELECT kind, ordinal, file_name FROM newest",
    "recovered_logs": f"WITH {ARTIFACTS} SELECT ordinal, file_name FROM found WHERE kind = 'recovered'",
    "last_30_events": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
    "legacy_anti_join": f"""WITH {ARTIFACTS} SELECT ordinal, file_name FROM found WHERE kind = 'log'
      AND file_name NOT IN (SELECT file_name FROM found WHERE kind = 'log' AND ordinal % 3 = 0)""",
    "session_recovery": """SELECT event_id, event_id % 5 IN (0, 3) AND event_id % 4 <> 0 AS recover,
      CASE WHEN event_id % 5 = 0 THEN event_id % 9 END AS tasks, CASE WHEN event_id % 5 = 0 THEN 'a,b' ELSE '' END AS breadcrumbs FROM events""",
    "resource_lookup": """WITH keys AS (SELECT n_nationkey, 'key_' || CAST(n_regionkey AS VARCHAR) AS key FROM nation),
      catalogue AS (SELECT 'key_' || CAST(r_regionkey AS VARCHAR) AS key, CASE WHEN r_regionkey = 3 THEN ' ' ELSE r_name END AS value FROM region WHERE r_regionkey <> 2)
      SELECT n_nationkey, key, coalesce(CASE WHEN trim(value) = '' THEN NULL ELSE value END, key) AS text FROM keys LEFT JOIN catalogue USING (key)""",
    "setting_default": """WITH rows AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN 'zh-Hans' END AS value FROM customer)
      SELECT c_custkey, CAST(coalesce(TRY_CAST(value AS INT), -1) AS BIGINT) AS as_int, c_custkey % 4 = 1 AS as_bool, coalesce(value, 'none') AS as_text FROM rows""",
    "settings_upsert": """WITH every AS (SELECT 'k' || CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value, -1 AS seq FROM customer
        UNION ALL SELECT 'k' || CAST(user_id AS VARCHAR), event_type, event_id FROM events)
      SELECT key, arg_max(value, seq) AS value FROM every GROUP BY key""",
    "language_resolve": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'zh-Hans' WHEN s_suppkey % 3 = 2 THEN 'en-US' WHEN s_suppkey % 5 IN (0, 1) THEN 'zh-Hans' ELSE 'en-US' END AS language,
      CASE WHEN s_suppkey % 7 = 0 THEN 'ja' ELSE CASE s_suppkey % 5 WHEN 0 THEN 'fr-FR' WHEN 1 THEN 'zh-CN' WHEN 2 THEN 'de' ELSE 'en-US' END END AS tag FROM supplier""",
    "output_dirs": "WITH rows AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '/mine' END AS given, '/d' || CAST(s_suppkey AS VARCHAR) AS input FROM supplier) SELECT s_suppkey, "
    + ", ".join(f"coalesce(given, input || '/{folder}') AS {name}" for name, folder in OUTPUT_FOLDERS.items())
    + " FROM rows",
    "distinct_paths": """WITH paths AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN '/In/P' ELSE '/in/p' END) || CAST(o_custkey AS VARCHAR) AS path FROM orders)
      SELECT arg_min(path, o_orderkey) AS path FROM paths GROUP BY lower(path)""",
    "time_format": f"""SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS shown, strftime(date_trunc('millisecond', ts), '%Y%m%d-%H%M%S-%g') AS in_name,
      CAST({ELAPSED} // 86400 AS VARCHAR) || 'd ' || lpad(CAST({ELAPSED} // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ELAPSED} // 60 % 60 AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST({ELAPSED} % 60 AS VARCHAR), 2, '0') AS lasted, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS iso FROM events""",
    "name_folding": f"""WITH people AS (SELECT c_custkey AS ordinal, [{', '.join(f"'{x}'" for x in NAMES)}][c_custkey % {len(NAMES)} + 1] || CAST(c_custkey // {3 * len(NAMES)} AS VARCHAR) AS name FROM customer),
      keyed AS (SELECT *, list_transform(string_split(name, ''), lambda c: CASE WHEN c IN ('ß', 'ı', 'ſ') THEN c ELSE upper(c) END) AS letters FROM people),
      units AS (SELECT *, array_to_string(letters, '') AS key, flatten(list_transform(letters, lambda c: CASE WHEN unicode(c) > 65535
        THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)) AS place FROM keyed)
      SELECT ordinal, row_number() OVER (ORDER BY place, ordinal) AS idx, name, first_value(name) OVER (PARTITION BY key ORDER BY ordinal) AS first_name,
        count(*) OVER (PARTITION BY key) AS n_same FROM units""",
    "name_template": """SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) || ': ' || n_name || ' of ' || CAST(n_regionkey AS VARCHAR) AS line,
      CASE WHEN n_nationkey % 3 = 0 THEN '(unknown)' ELSE n_name END AS known FROM nation""",
    "number_template": """SELECT c_custkey, printf('%.1f', CAST(round(CAST(c_acctbal AS DECIMAL(30,10)), 1) AS DOUBLE)) || ' of {0}' || c_name || ', {0} ' ||
      printf('%.2f', CAST(round(CAST(c_acctbal AS DECIMAL(30,10)), 2) AS DOUBLE)) || '  {3}' AS line FROM customer""",
    "orientation_kinds": """SELECT p_partkey, CASE WHEN p_partkey % 9 IN (0, 3, 7) THEN 'NeedsRebuild' ELSE 'Error' END AS issue_type,
      CASE WHEN p_partkey % 9 = 0 THEN 90 ELSE 0 END AS rotation_angle FROM part""",
    "existing_paths": f"WITH {ARTIFACTS} SELECT ordinal, file_name FROM found WHERE kind <> 'dump' AND ordinal % 4 NOT IN (0, 1)",
    "session_documents": """SELECT 's' || CAST(user_id AS VARCHAR) AS "SessionId", arg_max(event_id, ts) AS tasks, arg_max(event_type = 'view', ts) AS clean,
      arg_max(event_type, ts) AS breadcrumbs FROM events GROUP BY user_id""",
    "task_page": f"WITH {TASKS} SELECT idx, file_name, greatest(1, least(idx - 990, 20)) AS parallelism FROM tasks WHERE idx > 995 AND idx <= 1005",
}
