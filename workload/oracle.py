"""The same results as SQL over the given tables, written from each rule."""

from __future__ import annotations

import re

from .views import EXTENSIONS, IMAGE_HTML

_EXT = ", ".join(f"'{e}'" for e in EXTENSIONS)
_q = lambda text: text.replace("'", "''")
_PAGE_HTML = " || page_id || ".join(f"'{_q(p)}'" for p in IMAGE_HTML)

VIEWS: dict[str, str] = {
    "assets_v": f"""
        SELECT *, dir || '/' || stem || '.' || ext AS path FROM (
          SELECT doc_id, '/corpus' AS root, '/corpus/' || source || '/' || lang AS dir, 'doc' || doc_id AS stem,
            ([{_EXT}])[doc_id % 10 + 1] AS ext,
            CASE WHEN doc_id % 97 <> 0 THEN n_chars * 10 END AS size_bytes,
            TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS mtime,
            CASE WHEN doc_id % 97 <> 0 THEN 64 + (n_chars * 7) % 2000 END AS width,
            CASE WHEN doc_id % 97 <> 0 THEN 64 + (n_chars * 13) % 2000 END AS height
          FROM documents)""",
    "outputs_v": """
        SELECT '/corpus_upscaled' || dir[8:] || '/' || stem || '.png' AS output_path,
          mtime + to_seconds(CASE WHEN quality = 1 THEN 60 WHEN toxic = 1 THEN 0 ELSE -60 END) AS mtime
        FROM assets_v JOIN labels USING (doc_id)""",
    "named_v": "SELECT *, '/corpus_upscaled' || dir[8:] || '/' || stem || '.png' AS output_path FROM assets_v",
    "collide_v": """
        SELECT '/out' AS dir, l_orderkey || '_' || l_linenumber AS base, '.png' AS ext,
          l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem""",
    "images_v": """
        SELECT o_orderkey AS image_id, CAST(o_custkey % 3000 + 1 AS INTEGER) AS w,
          CAST((o_orderkey * 31) % 3000 + 1 AS INTEGER) AS h FROM orders""",
    "unit_v": """
        SELECT vec_id, list_transform(embedding, lambda e: least(greatest((e::DOUBLE + 1.0) / 2.0, 0.0), 1.0)) AS u
        FROM embeddings""",
    "flat_v": "SELECT vec_id, unnest(u) AS v, unnest(range(64)) AS i FROM unit_v",
    "rasters_v": """
        SELECT vec_id AS image_id, 0 AS c, CAST(i // 8 AS INTEGER) AS y, 8 AS h, CAST(i % 8 AS INTEGER) AS x, v FROM flat_v""",
    "rgba_v": """
        SELECT vec_id // 4 AS image_id, CAST(vec_id % 4 AS INTEGER) AS c, CAST(i // 8 AS INTEGER) AS y, 8 AS h,
          CAST(i % 8 AS INTEGER) AS x, v FROM flat_v""",
    "rgba_px": """
        SELECT image_id, y, x, max(CASE WHEN c = 0 THEN b END) AS r, max(CASE WHEN c = 1 THEN b END) AS g,
          max(CASE WHEN c = 2 THEN b END) AS b, max(CASE WHEN c = 3 THEN b END) AS a
        FROM (SELECT *, CAST(floor(v * 255) AS INTEGER) AS b FROM rgba_v) GROUP BY image_id, y, x""",
    "tall_v": """
        SELECT vec_id // 100 AS image_id, 0 AS c, CAST(vec_id % 100 AS INTEGER) AS y, 100 AS h,
          CAST(i AS INTEGER) AS x, v FROM flat_v""",
    "frames_v": """
        SELECT user_id AS anim_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
          CAST(floor(value * 10) AS INTEGER) AS duration_ms, event_type AS sig FROM events""",
    "islands_v": """
        SELECT *, frame_no - row_number() OVER (PARTITION BY anim_id, sig ORDER BY frame_no) AS grp FROM frames_v""",
    "runs_v": """
        SELECT anim_id, sig, grp, min(frame_no) AS frame_no, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
          count(*) AS n_frames FROM islands_v GROUP BY anim_id, sig, grp""",
    "ledger_v": """
        SELECT user_id % 10 AS run_id, '/in/' || event_id || '.png' AS input_path,
          '/out/' || event_id || '_up.png' AS output_path, 'm' || (user_id % 3) AS model,
          CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'done' END AS status,
          CASE WHEN event_type = 'signup' THEN 'output exists' END AS reason, value AS elapsed_s, ts FROM events""",
    "models_v": """
        SELECT *, '/models/' || name AS path FROM (
          SELECT p_partkey AS pos, p_size, CASE p_partkey % 5
            WHEN 0 THEN n || '_' || f || 'x.onnx' WHEN 1 THEN 'x2048_' || n || '.onnx' WHEN 2 THEN n || '.onnx'
            WHEN 3 THEN n || '-8X.onnx' ELSE f || 'x_' || n || '.onnx' END AS name
          FROM (SELECT *, replace(p_name, ' ', '_') AS n, ([1, 2, 4, 8])[p_size % 4 + 1] AS f FROM part))""",
    "links_v": """
        SELECT page_id, base, pos, CASE pos % 9 WHEN 0 THEN href WHEN 1 THEN tail WHEN 2 THEN '../' || tail || '.jpg'
            WHEN 3 THEN '//cdn.example.net/' || tail || '.TIFF?w=1' WHEN 4 THEN '?page=2' WHEN 5 THEN '#top'
            WHEN 6 THEN 'a/./b/../' || tail || '/..' WHEN 7 THEN 'https://Host.Example.com:8080/x/' || tail || '.tif'
            ELSE 'mailto:someone@example.com' END AS ref
        FROM (SELECT page_id, base, href, href[2:] AS tail, pos FROM (
          SELECT page_id, url AS base, unnest(hs) AS href, unnest(CAST(range(len(hs)) AS INTEGER[])) AS pos
          FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)))""",
    "image_pages_v": f"SELECT page_id, url, html || {_PAGE_HTML} AS html FROM pages",
    "texts_v": """
        SELECT doc_id, text || CASE doc_id % 4
          WHEN 0 THEN ' see https://img.example.com/a/' || doc_id || '.jpeg?w=10&h=20, ok'
          WHEN 1 THEN ' (HTTP://IMG.example.com/B' || doc_id || '.PNG)'
          WHEN 2 THEN ' https://x.example.com/page https://x.example.com/' || doc_id || '.tif' ELSE '' END AS text
        FROM documents""",
    "manifests_v": """
        SELECT page_id, 'https://site.example.org/chapter/' || lower(to_hex(page_id + 4096)) || '-ab/1' AS url,
          CASE WHEN page_id % 11 = 0 THEN '{"baseUrl":' || page_id || ','
               WHEN page_id % 7 = 0 THEN '{"baseUrl":"https://c.example.org","chapter":{"data":["x' || page_id || '.png"]}}'
               ELSE '{"baseUrl":"https://cdn' || (page_id % 5) || '.example.org","chapter":{"hash":"h' || page_id ||
                 '","data":["p1-' || page_id || '.png","p2.png"' || CASE WHEN page_id % 2 = 0 THEN ',"p3.jpg"' ELSE '' END || ']}}'
          END AS json FROM pages""",
    "presets_v": """
        SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN '{not json' ELSE
          '{"p":{"tile_width":"' || (c_custkey % 9 * 64) || '","no_such_field":"1","kernel":"k' || (c_custkey % 3) || '"}}'
          END AS json FROM customer""",
    "history_v": """
        SELECT event_type AS category, '/m/' || user_id || '.onnx' AS path, ts AS used_at, event_id FROM events""",
    "looks_v": """
        SELECT '/watch/' || user_id || '.png' AS path, CAST(floor(value) AS BIGINT) % 3 * 100 AS size_bytes, ts, event_id AS look_id
        FROM events""",
}


def _reference(sql: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", sql)}


def with_views(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """The statement with exactly the views it needs, in definition order."""
    extra = extra or {}
    needed = _reference(body + " ".join(extra.values()))
    while True:
        more = needed | {n for v in needed for n in _reference(VIEWS[v])}
        if more == needed:
            break
        needed = more
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed] + [f"{n} AS ({q})" for n, q in extra.items()]
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


ORACLE: dict[str, str] = {}


def add(name: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> None:
    ORACLE[name] = with_views(body, extra, recursive)


# ---- sources ---------------------------------------------------------------------

add("scan_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
add("read_manifest_json", """
    SELECT page_id, regexp_extract(url, '/chapter/([a-f0-9-]+)', 1) AS chapter_id, CAST(pos AS INTEGER) AS pos,
      json_extract_string(json, '$.baseUrl') || '/data/' || json_extract_string(json, '$.chapter.hash') || '/' || file AS url,
      1000 AS width, 1500 AS height, 'Page ' || (pos + 1) AS alt
    FROM (SELECT *, unnest(files) AS file, unnest(range(len(files))) AS pos FROM (
      SELECT *, CAST(json_extract_string(json, '$.chapter.data[*]') AS VARCHAR[]) AS files FROM manifests_v WHERE json_valid(json)))
    WHERE json_extract_string(json, '$.chapter.hash') IS NOT NULL""")
add("read_model_list", """
    SELECT pos, CAST(item AS INTEGER) AS item, CASE WHEN item = 0 THEN path ELSE '/models/second.onnx' END AS model_path
    FROM models_v, range(2) r(item) WHERE pos % 6 <> 0""")
add("read_presets", "SELECT c_custkey, CAST(c_custkey % 6 <> 0 AS BIGINT) AS n_presets FROM customer")

# ---- filters ---------------------------------------------------------------------

add("filter_extension", "SELECT doc_id, path FROM assets_v WHERE lower(ext) <> 'txt'")
add("skip_reason", """
    SELECT doc_id, output_path, there AS "exists", CASE
      WHEN there THEN 'output exists'
      WHEN width < 300 THEN 'width ' || width || ' < min 300'
      WHEN height < 200 THEN 'height ' || height || ' < min 200'
      WHEN width > 1900 THEN 'width ' || width || ' > max 1900'
      WHEN height > 1800 THEN 'height ' || height || ' > max 1800'
      WHEN width / height < 0.5 THEN 'aspect ' || printf('%.2f', width / height) || ' < min 0.5'
      WHEN width / height > 2.0 THEN 'aspect ' || printf('%.2f', width / height) || ' > max 2.0' END AS reason
    FROM (SELECT *, output_path IN (SELECT output_path FROM outputs_v) AS there FROM named_v)""")
add("filter_aspect", """
    SELECT doc_id, mode, CASE WHEN width IS NULL THEN NULL
      WHEN mode = 'landscape' AND width <= height THEN 'not landscape'
      WHEN mode = 'portrait' AND width >= height THEN 'not portrait'
      WHEN mode = 'square' AND (width / height < 0.95 OR width / height > 1.05) THEN 'not square' END AS reason
    FROM assets_v, (SELECT unnest(['any', 'landscape', 'portrait', 'square']) AS mode)""")
add("is_webpage_url", """
    SELECT page_id, pos, ref, pos % 9 = 7 AS is_page FROM links_v""")
add("has_transparency", "SELECT image_id, bool_or(c = 3 AND v < 1) AS transparent FROM rgba_v GROUP BY image_id")
add("frame_count", """
    SELECT user_id AS anim_id, count(*) AS n_frames, count(*) > 1 AS animated FROM events GROUP BY user_id""")
add("ready_files", """
    SELECT a.path, a.size_bytes, a.look_id FROM looks_v a ASOF JOIN looks_v b ON a.path = b.path AND a.ts > b.ts
    WHERE a.size_bytes > 0 AND a.size_bytes = b.size_bytes""")

_NATURAL = "list_transform(regexp_extract_all(lower(path), '\\D*\\d+|\\D+'), lambda m: [regexp_replace(m, '\\d+$', ''), lpad(regexp_extract(m, '\\d+$'), 30, '0')])"
add("natural_sort", f"SELECT path, row_number() OVER (ORDER BY {_NATURAL}, path) - 1 AS rank FROM assets_v")
add("resume_from", f"""
    SELECT doc_id, path FROM (SELECT *, row_number() OVER (ORDER BY {_NATURAL}, path) AS rn FROM assets_v) WHERE rn > 137""")

# ---- projections -----------------------------------------------------------------

add("output_path", """
    SELECT doc_id, dir || '/' || stem || '_upscaled_m4x.png' AS beside,
      '/corpus_upscaled/' || source || '/' || lang || '/' || stem || '.png' AS folder,
      '/elsewhere_upscaled/' || stem || '.png' AS outside,
      dir || '/upscaled/' || stem || '_upscaled.png' AS default_dir,
      '/out/' || stem || '_upscaled.' || ext AS given_dir,
      '/corpus_upscaled/' || source || '/' || lang || '/' || stem || '_secondary.png' AS secondary
    FROM assets_v JOIN documents USING (doc_id)""")
add("format_hms", """
    SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, len(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' ||
      lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hms
    FROM (SELECT event_id, CAST(greatest(0, floor(value * 1000 - 5.0 + 0.5)) AS BIGINT) AS s FROM events)""")
add("model_scale", """
    SELECT pos, path, CASE WHEN regexp_matches(n, '8x_|_8x|x8|-8x|8x\\.') THEN 8 WHEN regexp_matches(n, '4x_|_4x|x4|-4x|4x\\.') THEN 4
      WHEN regexp_matches(n, '2x_|_2x|x2|-2x|2x\\.') THEN 2 WHEN regexp_matches(n, '1x_|_1x|x1|-1x|1x\\.') THEN 1 ELSE 4 END AS scale
    FROM (SELECT *, lower(name) AS n FROM models_v)""")
add("artifact_key", """
    SELECT pos, path[:-6] || '_fp16_' || (p_size * 64) || 'x512_opt5.trt' AS fp16,
      path[:-6] || '_fp32_1024x' || (p_size * 64) || '_opt5_cg.trt' AS fp32 FROM models_v""")
add("extract_image_url", """
    SELECT doc_id, nullif(regexp_extract(text, '(?i)https?://[^\\s<>"'']+\\.(png|jpg|jpeg|gif|webp|bmp|tiff?)(\\?[^\\s<>"'']*)?', 0), '') AS url
    FROM texts_v""")
_RESOLVED = """
    SELECT *, origin || CASE pos % 9 WHEN 0 THEN href WHEN 1 THEN folder || tail WHEN 2 THEN up || tail || '.jpg'
        WHEN 4 THEN bpath || '?page=2' WHEN 5 THEN bpath || bquery || '#top' WHEN 6 THEN folder || 'a/' ELSE '' END AS near
    FROM (SELECT l.*, p.url, regexp_extract(url, '^[a-z]+://[^/]+') AS origin, regexp_extract(url, '^[a-z]+:') AS scheme,
        regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS bpath,
        regexp_extract(url, '^[a-z]+://[^/]+([^?#]*/)', 1) AS folder,
        regexp_extract(url, '^[a-z]+://[^/]+((?:/[^/?#]+)*)/[^/?#]+/', 1) || '/' AS up,
        regexp_extract(url, '(\\?[^#]*)', 1) AS bquery,
        CASE pos % 9 WHEN 0 THEN ref END AS href,
        CASE pos % 9 WHEN 1 THEN ref WHEN 2 THEN ref[4:-5] END AS tail
      FROM links_v l JOIN pages p USING (page_id))"""
add("resolve_url", """
    SELECT page_id, pos, CASE pos % 9 WHEN 3 THEN scheme || ref WHEN 7 THEN ref WHEN 8 THEN ref ELSE near END AS url
    FROM resolved""", {"resolved": _RESOLVED})
add("url_filename", """
    SELECT page_id, pos, CASE WHEN name LIKE '%.%' THEN name ELSE 'image_' || md5(u)[1:8] || '.jpg' END AS name,
      CASE WHEN name NOT LIKE '%.%' THEN 'downloaded_image.png'
           WHEN regexp_matches(lower(name), '^.+\\.(png|jpg|jpeg|webp|bmp|tiff|tif|gif)$') THEN name
           WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^(.+)\\.[^.]+$', 1) || '.png'
           ELSE name || '.png' END AS dropped
    FROM (SELECT *, regexp_extract(regexp_replace(regexp_replace(u, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[^/]*$') AS full_name,
            regexp_replace(regexp_replace(full_name, ';.*$', ''), '^mailto:', '') AS name
          FROM (SELECT *, CASE pos % 9 WHEN 3 THEN scheme || ref WHEN 7 THEN ref WHEN 8 THEN ref ELSE near END AS u FROM resolved))""",
    {"resolved": _RESOLVED})
add("target_size", """
    SELECT image_id, CAST(w // 2 AS BIGINT) AS w0, CAST(h // 2 AS BIGINT) AS h0, CAST(1920 AS BIGINT) AS w1,
      CAST(floor(h * (1920.0::DOUBLE / w)) AS BIGINT) AS h1, CAST(floor(w * (1080.0::DOUBLE / h)) AS BIGINT) AS w2,
      CAST(1080 AS BIGINT) AS h2, CAST(800 AS BIGINT) AS w3, CAST(600 AS BIGINT) AS h3 FROM images_v""")
add("rgb_to_yuv444", """
    SELECT image_id, y, x, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS yy,
      CAST(floor(least(255, greatest(0, r * -0.169::DOUBLE + g * -0.331::DOUBLE + b * 0.5::DOUBLE + 128))) AS INTEGER) AS uu,
      CAST(floor(least(255, greatest(0, r * 0.5::DOUBLE + g * -0.419::DOUBLE + b * -0.081::DOUBLE + 128))) AS INTEGER) AS vv,
      round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 6) AS luma,
      round(r * (a / 255) + (1 - a / 255) * 255, 6) AS on_white
    FROM rgba_px""")
add("to_uint8", """
    SELECT vec_id, x, b, round(b / 255, 6) AS unit FROM (
      SELECT vec_id, CAST(x AS INTEGER) AS x, CASE WHEN x = 64 OR x = 66 THEN 0 WHEN x = 65 THEN 255
        WHEN e <= 0 THEN 0 WHEN e >= 1 THEN 255 ELSE CAST(trunc(e * 255) AS INTEGER) END AS b
      FROM (SELECT vec_id, unnest(list_concat(embedding, [0, 0, 0]::FLOAT[]))::DOUBLE * 4 AS e, unnest(range(67)) AS x FROM embeddings))""")
add("tile_band", """
    SELECT c_custkey AS device_id, tw AS tile_w, th AS tile_h FROM customer JOIN (VALUES (0, 6, 512, 512), (6, 8, 512, 768),
      (8, 10, 768, 768), (10, 12, 768, 1024), (12, 16, 1024, 1024), (16, 1000, 1088, 1920)) b(lo, hi, tw, th)
      ON c_custkey % 24 >= lo AND c_custkey % 24 < hi""")
add("ledger_text", """
    SELECT input_path, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || CASE status
      WHEN 'skipped' THEN 'SKIPPED: ' || input_path[5:] || ' (' || reason || ')'
      ELSE input_path[5:] || ' -> ' || output_path[6:] || ' (' || printf('%.2f', elapsed_s) || 's)' END AS entry
    FROM ledger_v WHERE status IN ('done', 'skipped')""")

add("export_log_lines", """
    SELECT input_path, '"' || '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || CASE status
      WHEN 'skipped' THEN 'SKIPPED: ' || input_path[5:] || ' (' || reason || ')'
      ELSE input_path[5:] || ' -> ' || output_path[6:] || ' (' || printf('%.2f', elapsed_s) || 's)' END || ' ' || chr(34) || chr(34) || model || chr(34) || chr(34) || chr(34) AS line
    FROM ledger_v WHERE status IN ('done', 'skipped')""")
add("settle", """
    SELECT folder, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n_changes
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (
      SELECT CAST(user_id AS VARCHAR) AS folder, ts, event_id,
        CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY folder, grp""")
add("image_headers", "SELECT path, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height FROM assets_v")
add("plan_without_overwriting", """
    SELECT doc_id, '/out/n' || b || '_upscaled' || CASE WHEN pick = 1 THEN '' ELSE '_' || lpad(CAST(pick AS VARCHAR), 3, '0') END || '.png' AS output_path,
      false AS "exists", CASE WHEN width < 300 THEN 'width ' || width || ' < min 300' END AS reason
    FROM (SELECT *, (list_filter(range(1, k + 6), lambda i: NOT list_contains(coalesce(used, []), i)))[k] AS pick
      FROM (SELECT doc_id, width, b, used, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS k
        FROM (SELECT *, doc_id // 4 AS b FROM assets_v)
        LEFT JOIN (SELECT p_partkey // 3 AS b, list(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE p_partkey % 3 + 2 END) AS used FROM part GROUP BY 1) USING (b)))""")

# ---- arrays, maps, JSON ----------------------------------------------------------

add("best_srcset", """
    SELECT pos, CASE pos % 5 WHEN 0 THEN name || ' 1x, big_' || name || ' 2x'
        WHEN 1 THEN name || ' ' || p_size || 'w, half.png 25w , last.png 25w' WHEN 2 THEN name || ', b.png 1.5X,, c.png 1400w'
        WHEN 3 THEN 'bad.png 10.5w, ' || name || ' 20w' ELSE ' ' || name || ' 7h, z.png' END AS srcset,
      CASE pos % 5 WHEN 0 THEN 'big_' || name WHEN 1 THEN CASE WHEN p_size >= 25 THEN name ELSE 'half.png' END
        WHEN 2 THEN 'b.png' WHEN 4 THEN name END AS best
    FROM models_v""")
add("strip_exif", """
    SELECT doc_id AS image_id, unnest([271, 36867]) AS tag, unnest(['Maker' || doc_id, '2024:' || doc_id]) AS value FROM documents""")
add("keep_png_text", """
    SELECT doc_id AS image_id, unnest(['Software', 'Title']) AS key, unnest(['tool ' || doc_id, source]) AS value FROM documents""")
add("apply_preset", """
    SELECT c_custkey, unnest(['tile_width', 'kernel', 'fp16']) AS field, unnest(CASE WHEN c_custkey % 6 = 0 THEN ['512', 'lanczos', '0']
      ELSE [CAST(c_custkey % 9 * 64 AS VARCHAR), 'k' || (c_custkey % 3), '0'] END) AS value FROM customer""")
add("save_delete_preset", """
    SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE c_name || ',p' END AS after_save, c_name AS after_delete FROM customer""")
add("recent", """
    SELECT path, strftime(max(used_at), '%Y-%m-%d %H:%M:%S.%f') AS used_at FROM history_v GROUP BY path ORDER BY 2 DESC, path LIMIT 10""")

# ---- joins -----------------------------------------------------------------------

add("mark_existing", """
    SELECT doc_id, output_path, output_path IN (SELECT output_path FROM outputs_v) AS "exists" FROM named_v""")
add("resume", """
    SELECT '/in/' || event_id || '.png' AS path, 'm1' AS model FROM events
    WHERE NOT (user_id % 3 = 1 AND event_type NOT IN ('error', 'signup'))""")
add("model_queue", """
    SELECT doc_id, CAST(i AS INTEGER) AS model_pos, m AS model_path FROM documents, (SELECT unnest(range(4)) AS i,
      unnest(['/models/small_ring_8x.onnx', '/models/blue_bolt.onnx', '/models/missing.onnx', '/models/x2048_red_widget.onnx']) AS m)
    WHERE m IN (SELECT path FROM models_v)""")
add("stale", """
    SELECT doc_id, n.output_path FROM named_v n WHERE NOT EXISTS (
      SELECT 1 FROM outputs_v o WHERE o.output_path = n.output_path AND o.mtime > n.mtime)""")
_RULES = """
    SELECT DISTINCT d AS domain FROM (SELECT lower(n_name)[1:3] || '.example.com' AS d FROM nation
      UNION ALL SELECT regexp_extract(url, '//[^/.]+\\.([^/]+)/', 1) FROM pages
      UNION ALL SELECT lower(n_name)[1:n_nationkey % 3 + 1] FROM nation) WHERE d <> ''"""
_HOSTS = """
    SELECT page_id, pos, CASE pos % 9 WHEN 3 THEN 'cdn.example.net' WHEN 7 THEN 'host.example.com' ELSE regexp_extract(base, '//([^/]*)', 1) END AS host
    FROM links_v WHERE pos % 9 <> 8"""
add("match_domains_suffix", """
    SELECT page_id, pos, domain FROM hosts JOIN rules ON host = domain OR host LIKE '%.' || domain""", {"rules": _RULES, "hosts": _HOSTS})
add("match_domains_substring", """
    SELECT page_id, pos, domain FROM hosts JOIN rules ON contains(host, domain)""", {"rules": _RULES, "hosts": _HOSTS})
# Tile starts 0, 2, 4, 6: the loop stops once start + overlap reaches the side.
_GRID8 = "SELECT 4 * iy + ix AS tile_no, ix * 2 AS x0, iy * 2 AS y0, least(4, 8 - ix * 2) AS tw, least(4, 8 - iy * 2) AS th FROM range(4) a(ix), range(4) b(iy)"
add("tiles_for_pixels", """
    SELECT image_id, y, x, CAST(tile_no AS INTEGER) AS tile_no, CAST(y - y0 AS INTEGER) AS ty, CAST(x - x0 AS INTEGER) AS tx, round(v, 6) AS v
    FROM rasters_v JOIN grid ON x BETWEEN x0 AND x0 + tw - 1 AND y BETWEEN y0 AND y0 + th - 1""", {"grid": _GRID8})
add("crop", """
    SELECT image_id, c, CAST(r.y - top AS INTEGER) AS y, CAST(bh AS INTEGER) AS h, CAST(r.x - bx AS INTEGER) AS x, round(v, 6) AS v
    FROM rasters_v r JOIN (
      SELECT vec_id AS image_id, s AS bw, s AS bh, greatest(0, least(p + n // 2 - s // 2, 8 - s)) AS bx,
        greatest(0, least(p + n // 2 - s // 2, 8 - s)) AS top
      FROM (SELECT vec_id, vec_id % 11 - 2 AS p, vec_id % 12 + 1 AS n, least(vec_id % 12 + 1, 8) AS s FROM embeddings)) b USING (image_id)
    WHERE r.x >= bx AND r.x < bx + bw AND r.y >= top AND r.y < top + bh""")
add("copy_metadata", """
    SELECT doc_id AS image_id, path, CAST(2 AS BIGINT) AS n_exif, 'Maker' || doc_id AS maker, source AS title
    FROM assets_v JOIN documents USING (doc_id)""")

# ---- resize ----------------------------------------------------------------------

_KERNEL = {
    "hermite": ("(2 * a - 3) * a * a + 1", "a <= 1", 1.0),
    "lanczos": ("CASE WHEN a < 1e-8 THEN 1 ELSE 3 * sin(pi() * a) * sin(pi() * a / 3) / (pi() * pi() * a * a) END", "a < 3", 3.0),
    # The distance is a * 3 here: the textbook kernel has all its lobes, negative ones too.
    "lanczos_full": ("CASE WHEN a < 1e-8 THEN 1 ELSE sin(pi() * a * 3) * sin(pi() * a) / (3 * pi() * pi() * a * a) END", "a < 1", 3.0),
    "catmull_rom": ("CASE WHEN a <= 1 THEN 1.5 * a * a * a - 2.5 * a * a + 1 ELSE -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2 END", "a <= 2", 2.0),
}


def _weights(pairs: str, kernel: str) -> str:
    """(old_n, new_n, o, k, w): normalised, then without negative weights; same size is the identity."""
    expr, inside, radius = _KERNEL[kernel]
    return f"""
      SELECT old_n, new_n, o, greatest(0, least(old_n - 1, kk)) AS k, CASE WHEN old_n = new_n THEN CAST(kk = o AS INTEGER)
          ELSE raw / sum(raw) OVER (PARTITION BY old_n, new_n, o) END AS w
      FROM (SELECT old_n, new_n, o, kk, CASE WHEN {inside} THEN {expr} ELSE 0 END::DOUBLE AS raw
        FROM (SELECT *, abs((ctr - kk) / reach) AS a
          FROM (SELECT *, unnest(range(CAST(floor(ctr - reach) AS BIGINT), CAST(ceil(ctr + reach) AS BIGINT) + 1)) AS kk
            FROM (SELECT *, (o + 0.5::DOUBLE) / (new_n::DOUBLE / old_n) - 0.5::DOUBLE AS ctr,
                CASE WHEN new_n < old_n THEN {radius}::DOUBLE / (new_n::DOUBLE / old_n) ELSE {radius}::DOUBLE END AS reach
              FROM (SELECT old_n, new_n, unnest(range(new_n)) AS o FROM ({pairs})))))) QUALIFY w {'<>' if kernel == 'lanczos_full' else '>'} 0"""


def _resized(source: str, old: tuple[int, int], new: tuple[int, int], kernel: str) -> dict[str, str]:
    """Vertical pass, then horizontal; one CTE per step, the last is `resized`."""
    (ow, oh), (nw, nh) = old, new
    return {
        "wy": _weights(f"SELECT {oh} AS old_n, {nh} AS new_n", kernel),
        "wx": _weights(f"SELECT {ow} AS old_n, {nw} AS new_n", kernel),
        "down": f"SELECT image_id, c, o AS y, x, sum(v * w) AS v FROM {source} JOIN wy ON k = y GROUP BY image_id, c, o, x",
        "resized": "SELECT image_id, c, y, o AS x, least(1, greatest(0, sum(v * w))) AS v FROM down JOIN wx ON k = x GROUP BY image_id, c, y, o",
    }


def _long(source: str, h: int) -> str:
    return f"""SELECT image_id, c, CAST(y AS INTEGER) AS y, {h} AS h, CAST(x AS INTEGER) AS x, round(v, 6) + 0.0 AS v FROM {source}"""


add("resize_hermite", _long("resized", 13), _resized("rasters_v", (8, 8), (5, 13), "hermite"))
add("resize_lanczos", _long("resized", 30), _resized("tall_v", (64, 100), (48, 30), "lanczos"))
add("resize_lanczos_full", _long("resized", 30), _resized("tall_v", (64, 100), (48, 30), "lanczos_full"))
add("frame_signature", """
    SELECT image_id, string_agg(printf('%02X', CAST(floor(least(255.0, greatest(0.0, grey * 255.0::DOUBLE))) AS INTEGER)), '' ORDER BY y, x) AS sig
    FROM (SELECT image_id, y, x, sum(CASE c WHEN 0 THEN v END) * 0.299::DOUBLE + sum(CASE c WHEN 1 THEN v END) * 0.587::DOUBLE + sum(CASE c WHEN 2 THEN v END) * 0.114::DOUBLE AS grey
      FROM resized GROUP BY image_id, y, x) GROUP BY image_id""", _resized("(SELECT * FROM rgba_v WHERE c < 3)", (8, 8), (16, 16), "lanczos_full"))
add("resize_catmull_rom", _long("resized", 4), _resized("rasters_v", (8, 8), (12, 4), "catmull_rom"))
add("resize_weights", """
    SELECT CAST(old_n AS INTEGER) AS old_n, CAST(new_n AS INTEGER) AS new_n, count(*) AS n_taps, round(sum(w), 6) AS total,
      round(sum(w * k * (o + 1)) / any_value(new_n) / any_value(old_n), 6) AS moment
    FROM (SELECT old_n, new_n, o, k, sum(w) AS w FROM weights GROUP BY ALL) GROUP BY old_n, new_n""",
    {"weights": _weights("SELECT DISTINCT w AS old_n, greatest(w // 2, 1) AS new_n FROM images_v", "hermite")})
_there = _resized("tall_v", (64, 100), (32, 50), "hermite")
_back = {f"{k}2": v.replace("tall_v", "resized").replace(" wx ", " wx2 ").replace(" wy ", " wy2 ").replace("FROM down", "FROM down2")
         for k, v in _resized("tall_v", (32, 50), (64, 100), "hermite").items()}
add("compare_models", """
    SELECT image_id, count(*) AS n_values, round(avg(abs(a.v - b.v)), 6) AS mean_abs_diff
    FROM tall_v a JOIN resized2 b USING (image_id, c, y, x) GROUP BY image_id""", {**_there, **_back})
add("with_secondary_output", """
    SELECT 'primary' AS variant, image_id, 100 AS height, 64 AS width, round(sum(v), 6) AS total FROM tall_v GROUP BY image_id
    UNION ALL SELECT 'secondary', image_id, 50, 32, round(sum(v), 6) FROM resized GROUP BY image_id""",
    _resized("tall_v", (64, 100), (32, 50), "hermite"))

# ---- blending --------------------------------------------------------------------


def _blend(source: str, w: int, h: int, tile: tuple[int, int], overlap: int, scale: int, feathered: bool, value: str, inclusive: bool = False) -> dict[str, str]:
    """Per output pixel: sum(weight * value) / sum(weight) over the tiles that hold it (nearest model)."""
    tw, th = tile
    axis = lambda size, t, name: f"""
        SELECT i AS {name}n, i * {t - 2 * overlap} AS {name}0, least({t}, {size} - i * {t - 2 * overlap}) AS {name}t
        FROM range(greatest(1, CAST(ceil(({size} - {overlap}) / {t - 2 * overlap}) AS BIGINT))) r(i)"""
    ramp = overlap * scale
    steps = max(ramp - 1, 1) if inclusive else ramp

    def side(p: str, size: int, n: str) -> str:
        first = "TRUE" if feathered else f"{n}0 > 0"
        last = "TRUE" if feathered else f"{n}0 + {n}t < {size}"
        many = f"({w} > {tw} OR {h} > {th})"
        return (f"(CASE WHEN {many} AND {first} AND {p} < {ramp} THEN {p} / {steps} ELSE 1 END * "
                f"CASE WHEN {many} AND {last} AND {n}t * {scale} - 1 - {p} < {ramp} THEN ({n}t * {scale} - 1 - {p}) / {steps} ELSE 1 END)")

    return {
        "ax": axis(w, tw, "x"), "ay": axis(h, th, "y"),
        "outpx": f"""SELECT image_id, c, y * {scale} + dy AS oy, x * {scale} + dx AS ox, v
            FROM {source}, range({scale}) a(dx), range({scale}) b(dy)""",
        "weighted": f"""SELECT image_id, c, oy, ox, {value} AS v, {side(f'(ox - x0 * {scale})', w, 'x')} * {side(f'(oy - y0 * {scale})', h, 'y')} AS wt
            FROM outpx JOIN ax ON ox >= x0 * {scale} AND ox < (x0 + xt) * {scale}
            JOIN ay ON oy >= y0 * {scale} AND oy < (y0 + yt) * {scale}""",
        "blended": """SELECT image_id, c, oy AS y, ox AS x, CASE WHEN sum(wt) > 1e-8 THEN sum(wt * v) / sum(wt) ELSE sum(wt * v) END AS v
            FROM weighted GROUP BY image_id, c, oy, ox""",
    }


_NUMBERED = "((yn * 4 + xn) * 0.1)::DOUBLE"
add("blend_tiles", _long("blended", 16), _blend("rasters_v", 8, 8, (4, 4), 1, 2, False, _NUMBERED))
add("blend_tiles_feathered", _long("blended", 16), _blend("rasters_v", 8, 8, (4, 4), 1, 2, True, _NUMBERED))
add("blend_tiles_inclusive", _long("blended", 24), _blend("rasters_v", 8, 8, (7, 7), 1, 3, False, "((yn * 2 + xn) * 0.1)::DOUBLE", True))
add("upscale", """
    SELECT image_id, c, CAST(y * 2 + dy AS INTEGER) AS y, 16 AS h, CAST(x * 2 + dx AS INTEGER) AS x, round(v, 6) AS v
    FROM rasters_v, range(2) a(dx), range(2) b(dy)""")
add("upscale_with_model", """
    SELECT image_id, c, CAST(y * 2 + dy AS INTEGER) AS y, 16 AS h, CAST(x * 2 + dx AS INTEGER) AS x, round(v::FLOAT::DOUBLE, 6) AS v
    FROM rgba_v, range(2) a(dx), range(2) b(dy)""")
add("upscale_feathered", _long("blended", 200), _blend("tall_v", 64, 100, (32, 48), 4, 2, True, "v"))

# ---- aggregations ----------------------------------------------------------------

add("merge_islands", """
    SELECT anim_id, row_number() OVER (PARTITION BY anim_id ORDER BY frame_no) AS island, frame_no, sig, duration_ms, n_frames FROM runs_v""")
add("animation_stats", """
    SELECT anim_id, count(*) AS n_kept, round(avg(duration_ms), 9) AS avg_duration_ms,
      round(CASE WHEN avg(duration_ms) > 0 THEN 1000 / avg(duration_ms) ELSE 10 END, 9) AS fps,
      CAST(sum(runs_v.n_frames - 1) AS BIGINT) AS n_dropped, any_value(f.n_frames) AS n_frames, any_value(any_alpha) AS any_alpha
    FROM runs_v JOIN (SELECT anim_id, count(*) AS n_frames, bool_or(duration_ms % 97 = 0) AS any_alpha FROM frames_v GROUP BY anim_id) f USING (anim_id)
    GROUP BY anim_id""")
add("frame_islands", """
    SELECT anim_id, frame_no, sig, dense_rank() OVER (PARTITION BY anim_id ORDER BY start) AS island
    FROM (SELECT *, min(frame_no) OVER (PARTITION BY anim_id, sig, grp) AS start FROM islands_v)""")
add("batch_summary", """
    SELECT run_id, count(*) AS total, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'done') AS done,
      count(*) FILTER (status <> 'skipped') AS processed,
      'Completed ' || count(*) FILTER (status <> 'skipped') || ' files' || CASE WHEN count(*) FILTER (status = 'skipped') > 0
        THEN ' (' || count(*) FILTER (status = 'skipped') || ' skipped)' ELSE '' END AS message,
      round(avg(elapsed_s) FILTER (status = 'done'), 6) AS avg_s FROM ledger_v GROUP BY run_id""")
add("output_collisions", """
    SELECT '/out/' || base || '.png' AS output_path, count(*) AS n FROM collide_v GROUP BY base HAVING count(*) > 1""")
add("normalize_range", """
    SELECT image_id, c, y, h, x, round(CASE WHEN image_id % 2 = 0 AND c = 3 THEN v * 255 ELSE v END, 6) AS v FROM rgba_v""")
_COLORS = """
    SELECT image_id, (r // 8) * 1024 + (g // 8) * 32 + b // 8 AS color, count(*) AS n FROM rgba_px GROUP BY 1, 2"""
_TOP = "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, color) AS rank FROM colors QUALIFY rank <= 8"
add("top_colors", "SELECT image_id, CAST(color AS INTEGER) AS color, n, CAST(rank AS INTEGER) AS rank FROM top", {"colors": _COLORS, "top": _TOP})
add("palette_map", """
    SELECT image_id, CAST(color AS INTEGER) AS color, any_value(n) AS n, CAST(min(d) AS INTEGER) AS dist,
      CAST(arg_min(other, d * 100 + rank) AS INTEGER) AS palette_color FROM (
      SELECT a.*, p.color AS other, p.rank, (a.color // 1024 - p.color // 1024) ** 2 + (a.color // 32 % 32 - p.color // 32 % 32) ** 2 + (a.color % 32 - p.color % 32) ** 2 AS d
      FROM colors a JOIN top p USING (image_id)) GROUP BY image_id, color""", {"colors": _COLORS, "top": _TOP})
add("corpus_profile", """
    SELECT suffix, aspect, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(max(width) AS INTEGER) AS max_width,
      CAST(max(height) AS INTEGER) AS max_height, CAST(grouping(suffix, aspect) AS BIGINT) AS level
    FROM (SELECT *, lower(ext) AS suffix, CASE WHEN width IS NULL THEN 'unknown' WHEN width / height BETWEEN 0.95 AND 1.05 THEN 'square'
      WHEN width > height THEN 'landscape' ELSE 'portrait' END AS aspect FROM assets_v) GROUP BY ROLLUP (suffix, aspect)""")

# ---- windows ---------------------------------------------------------------------

add("running_progress", """
    SELECT run_id, input_path, completed, round(elapsed, 6) AS elapsed, round(elapsed / completed + 1.234e-7, 6) AS avg_s,
      round((total - completed) * (elapsed / completed) + 1.234e-7, 6) AS eta_s
    FROM (SELECT run_id, input_path, row_number() OVER w AS completed, sum(elapsed_s) OVER w AS elapsed FROM ledger_v WHERE status = 'done'
      WINDOW w AS (PARTITION BY run_id ORDER BY ts, input_path ROWS UNBOUNDED PRECEDING))
    JOIN (SELECT run_id, count(*) AS total FROM ledger_v GROUP BY run_id) USING (run_id)""")
# Row by row: e(n) = (1 - a) e(n-1) + a x(n), one recursion step per rank for all runs at once.
add("ema", "SELECT nullif(run_id, -1) AS run_id, input_path, round(a + 1.234e-7, 6) AS ema_30, round(b + 1.234e-7, 6) AS ema_5, round(c + 1.234e-7, 6) AS ema_1 FROM steps", {
    "shown": """SELECT CASE WHEN run_id = 3 THEN -1 ELSE run_id END AS run_id, input_path, elapsed_s AS x,
        CASE WHEN NOT ends_with(input_path, '7.png') THEN ts END AS ts FROM ledger_v WHERE status = 'done' AND elapsed_s > 0""",
    "ranked": """SELECT run_id, input_path, x, row_number() OVER (PARTITION BY run_id ORDER BY ts NULLS FIRST, input_path) AS n FROM shown""",
    "steps": """SELECT run_id, input_path, n, x AS a, x AS b, x AS c FROM ranked WHERE n = 1
        UNION ALL SELECT r.run_id, r.input_path, r.n, 0.7::DOUBLE * s.a + 0.3::DOUBLE * r.x, 0.95::DOUBLE * s.b + 0.05::DOUBLE * r.x, 0.99::DOUBLE * s.c + 0.01::DOUBLE * r.x
        FROM steps s JOIN ranked r ON r.run_id = s.run_id AND r.n = s.n + 1""",
}, recursive=True)
# The k-th request takes the k-th entry of the free list, written out as a list per name.
add("unique_names", """
    SELECT base, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN pick = 1 THEN base || '.png' ELSE base || '_' || lpad(CAST(pick AS VARCHAR), 3, '0') || '.png' END AS name
    FROM (SELECT *, (list_filter(range(1, k + 4), lambda i: NOT list_contains(coalesce(used, []), i)))[k] AS pick
      FROM (SELECT c.*, u.used, row_number() OVER (PARTITION BY base ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
        FROM collide_v c LEFT JOIN (SELECT base, list(DISTINCT i) AS used FROM (
            SELECT base, 2 AS i FROM collide_v WHERE contains(base || '_002.png', '7_')
            UNION ALL SELECT base, 1 FROM collide_v WHERE l_quantity > 40) GROUP BY base) u USING (base)))""")

# ---- sets ------------------------------------------------------------------------

add("new_files", "SELECT path FROM assets_v EXCEPT SELECT path FROM assets_v WHERE width > 1000")
add("add_unique", """
    SELECT path, CAST(list_no AS INTEGER) AS list_no, event_id AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY list_no, event_id) AS rn FROM (
        SELECT *, CASE category WHEN 'click' THEN 0 ELSE 1 END AS list_no FROM history_v)) WHERE rn = 1""")
add("remove_selected", """
    SELECT pos, path FROM models_v WHERE path NOT IN (SELECT path FROM models_v WHERE p_size > 25)""")

# ---- rasters ---------------------------------------------------------------------

# The tile loop as written: advance by the step, stop once start + overlap reaches the side.
_STARTS = """
    SELECT DISTINCT s AS size, 0 AS start FROM (SELECT w AS s FROM images_v UNION SELECT h FROM images_v)
    UNION ALL SELECT size, start + 480 FROM starts WHERE start + 480 + 16 < size AND start + 480 < size"""
add("tile_grid", """
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY b.start, a.start) - 1 AS INTEGER) AS tile_no,
      a.start AS x0, b.start AS y0, least(512, w - a.start) AS tw, least(512, h - b.start) AS th
    FROM images_v JOIN starts a ON a.size = w JOIN starts b ON b.size = h""", {"starts": _STARTS}, recursive=True)


def _near(source: str, w: int, h: int, offsets: list[tuple[int, int]]) -> dict[str, str]:
    """Every pixel sent to the pixels it neighbours, on coordinates mirrored at the edges."""
    def fold(i: int, n: int) -> int:
        return -i if i < 0 else 2 * (n - 1) - i if i >= n else i

    axis = lambda n, d: ", ".join(f"({i}, {j}, {fold(i + j, n)})" for i in range(n) for j in d)
    dys, dxs = sorted({o[0] for o in offsets} | {0}), sorted({o[1] for o in offsets} | {0})
    values = ", ".join(f"({dy}, {dx})" for dy, dx in [(0, 0), *offsets])
    return {"near": f"""
        SELECT q.image_id, q.c, a.y, b.x, a.dy, b.dx, q.v AS n FROM {source} q
        JOIN (VALUES {axis(h, dys)}) a(y, dy, sy) ON q.y = a.sy JOIN (VALUES {axis(w, dxs)}) b(x, dx, sx) ON q.x = b.sx
        WHERE (a.dy, b.dx) IN (VALUES {values})"""}


_CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
_DIAG = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _cas(limit: int, amount: float) -> dict[str, str]:
    return {
        "stats": """SELECT image_id, c, y, x, max(n) FILTER (dy = 0 AND dx = 0) AS e, min(n) AS mn, max(n) AS mx,
            sum(n) FILTER ((dy = 0) <> (dx = 0)) AS cross_sum FROM near GROUP BY image_id, c, y, x""",
        "sharp": f"""SELECT *, -sqrt(greatest(0, least(mn, {limit} - mx) / (mx + 1e-6))) * ({amount}::DOUBLE * (1/5 - 1/8) + 1/8) AS w FROM stats""",
    }


add("cas_sharpen", """
    SELECT image_id, c, y, 100 AS h, x, round(least(1, greatest(0, (cross_sum * w + e) / (1 + 4 * w))), 6) + 0.0 AS v FROM sharp""",
    {**_near("tall_v", 64, 100, _CROSS + _DIAG), **_cas(2, 0.5)})
add("cas_sharpen_cross", """
    SELECT image_id, c, y, 8 AS h, x, round(least(1, greatest(0, (cross_sum * w + e) / (1 + 4 * w))), 6) + 0.0 AS v FROM sharp WHERE c < 3
    UNION ALL SELECT image_id, c, y, h, x, round(v, 6) FROM rgba_v WHERE c = 3""",
    {**_near("rgba_v", 8, 8, _CROSS), **_cas(1, 0.8)})
_SMALL = _resized("rasters_v", (8, 8), (5, 3), "hermite")
add("pad_to_multiple", """
    SELECT image_id, c, CAST(py AS INTEGER) AS y, 8 AS h, CAST(px AS INTEGER) AS x, round(v, 6) + 0.0 AS v
    FROM resized JOIN (SELECT unnest([0,1,2,1,0,1,2,1]) AS sy, unnest(range(8)) AS py) ON sy = y
    JOIN (SELECT unnest([0,1,2,3,4,3,2,1]) AS sx, unnest(range(8)) AS px) ON sx = x""", _SMALL)
add("crop_back", """
    SELECT image_id, c, CAST(py AS INTEGER) AS y, 9 AS h, CAST(px AS INTEGER) AS x, round(v, 6) AS v
    FROM rasters_v JOIN (SELECT unnest([0,1,2,3,4,5,6,7,6]) AS sy, unnest(range(9)) AS py) ON sy = y
    JOIN (SELECT unnest([0,1,2,3,4,5,6,7,6,5,4]) AS sx, unnest(range(11)) AS px) ON sx = x""")
add("split_merge_alpha", "SELECT image_id, c, y, h, x, round(CASE WHEN c < 3 THEN v * 0.5::DOUBLE ELSE v END, 6) AS v FROM rgba_v")
# Every pixel of the flow: 64x100 -> 32x50 -> twice that (equal tiles blend to themselves) -> 38x60 -> sharper by 0.4.
_second = {f"{k}2": v.replace(" wx ", " wx2 ").replace(" wy ", " wy2 ").replace("FROM down", "FROM down2")
           for k, v in _resized("doubled", (64, 100), (38, 60), "hermite").items()}
add("prepare", """
    SELECT image_id, c, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(least(1, greatest(0, (cross_sum * w + e) / (1 + 4 * w))), 5) + 0.0 AS v FROM sharp""",
    {**_there, "doubled": "SELECT image_id, c, y * 2 + dy AS y, x * 2 + dx AS x, v FROM resized, range(2) a(dx), range(2) b(dy)",
     **_second, **_near("resized2", 38, 60, _CROSS + _DIAG), **_cas(2, 0.4)})

# The edge-adaptive filter, term by term; `ring` distances: 1 side, 2 corner or far, 3 outer.
_FLAT, _SIDE, _CORNER, _TWO = "dy = 0 AND dx = 0", "abs(dy) + abs(dx) = 1", "abs(dy) = 1 AND abs(dx) = 1", "abs(dy) + abs(dx) = 2"
_AROUND = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if 0 < abs(dy) + abs(dx) <= 3]
add("adaptive_sharpen", """
    SELECT image_id, c, CAST(y AS INTEGER) AS y, 8 AS h, CAST(x AS INTEGER) AS x,
      round(least(1, greatest(0, l + (3 * bounded + change) / 4 + (e - l) * ((l + greatest(0.9::DOUBLE * bounded, bounded) * 1.03::DOUBLE + 0.03::DOUBLE) / (l + 0.03::DOUBLE)))), 6) + 0.0 AS v
    FROM blurred JOIN bent USING (image_id, y, x)
    UNION ALL SELECT image_id, c, y, h, x, round(v, 6) FROM rgba_v WHERE c = 3""", {
    **_near("(SELECT * FROM rgba_v WHERE c < 3)", 8, 8, _AROUND),
    "blurred": f"""SELECT image_id, c, y, x, max(n) FILTER ({_FLAT}) AS e,
        sum(n * CASE WHEN {_FLAT} THEN 4 WHEN {_SIDE} THEN 2 WHEN {_CORNER} THEN 1 ELSE 0 END) / 16 AS blur FROM near GROUP BY image_id, c, y, x""",
    "detail": f"""SELECT image_id, c, y, x, any_value(blur) AS blur, sum(abs(blur - n) * (CASE WHEN {_FLAT} THEN 1.38 WHEN {_SIDE} THEN 1.15 WHEN {_CORNER} THEN 0.92 WHEN {_TWO} THEN 0.23 ELSE 0 END)::DOUBLE) AS d
        FROM near JOIN blurred USING (image_id, c, y, x) GROUP BY image_id, c, y, x""",
    "edges": """SELECT image_id, y, x, sqrt(sum(d * d)) * least(1, greatest(0, 0.266666681::DOUBLE + 0.9::DOUBLE * pow(2, sum(blur) * (-7.4::DOUBLE / 3)))) AS edge
        FROM detail GROUP BY image_id, y, x""",
    "grey": "SELECT image_id, y, x, dy, dx, sum(n * (CASE c WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END)::DOUBLE) AS g FROM near GROUP BY image_id, y, x, dy, dx",
    "lit": f"""SELECT image_id, y, x, max(g) FILTER ({_FLAT}) AS l, sum(g) FILTER ({_SIDE} OR {_CORNER}) / 8 AS mean, list_sort(list(g)) AS r FROM grey GROUP BY image_id, y, x""",
    "pulled": """SELECT image_id, y, x, l, (l - mean) / (0.5::DOUBLE * pow(edge, 3.5) + 0.625::DOUBLE) AS pull,
        least(abs((3 * greatest(r[24], l) + r[25]) / 4 - l), abs(l - (3 * least(r[2], l) + r[1]) / 4)) + 0.003::DOUBLE AS reach FROM lit JOIN edges USING (image_id, y, x)""",
    "limited": "SELECT *, least(reach, 0.1::DOUBLE * (1 - 0.056::DOUBLE) + reach * 0.056::DOUBLE) AS most FROM pulled",
    "softened": """SELECT *, least(1, greatest(0, t * (27 + t * t) / (27 + 9 * t * t))) * most AS soft
        FROM (SELECT *, abs(pull) / (most + 1e-6) AS t FROM limited)""",
    "changed": "SELECT *, CASE WHEN pull > 0 THEN 0.167::DOUBLE * abs(pull) + (1 - 0.167::DOUBLE) * soft ELSE -(0.25::DOUBLE * abs(pull) + 0.75::DOUBLE * soft) END AS change FROM softened",
    "bent": "SELECT image_id, y, x, l, change, least(1, greatest(0, l + change)) - l AS bounded FROM changed",
})
# Frames show every third picture; a run is one picture, told by its thumbnail.
add("upscale_animation", """
    SELECT vec_id // 25 AS anim_id, min(vec_id % 25) AS frame_no, CAST(sum(vec_id % 7 * 10) AS BIGINT) AS duration_ms, count(*) AS n_frames, any_value(total) AS total
    FROM embeddings JOIN (SELECT vec_id AS image_id, round(sum(v) * 4, 6) AS total FROM flat_v GROUP BY 1) t ON image_id = vec_id // 3 * 3
    GROUP BY vec_id // 25, vec_id // 3""")
add("y4m_parts", """
    SELECT anim_id, CAST(-1 AS BIGINT) AS frame_no, CAST(0 AS BIGINT) AS plane, CAST(0 AS BIGINT) AS "row", CAST(0 AS BIGINT) AS "offset", hex(head) AS bytes FROM heads
    UNION ALL SELECT anim_id, fn, -1, 0, length(head) + nth * 262, hex('FRAME' || chr(10)) FROM starts
    UNION ALL SELECT anim_id, fn, plane, y, length(any_value(head)) + any_value(nth) * 262 + 6 + plane * 64 + y * 8, string_agg(printf('%02X', b), '' ORDER BY x) FROM (
      SELECT image_id, y, x, unnest([0, 1, 2, 3]) AS plane, unnest([CAST(floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS INTEGER),
        CAST(floor(least(255, r * -0.169::DOUBLE + g * -0.331::DOUBLE + b * 0.5::DOUBLE + 128)) AS INTEGER),
        CAST(floor(least(255, r * 0.5::DOUBLE + g * -0.419::DOUBLE + b * -0.081::DOUBLE + 128)) AS INTEGER), a]) AS b FROM rgba_px)
    JOIN starts ON anim_id = image_id // 5 AND fn = image_id % 5 GROUP BY anim_id, fn, plane, y""", {
    "heads": """SELECT anim_id, 'YUV4MPEG2 W8 H8 F1000:' || CAST(floor(avg(fn * 10 + 40)) AS BIGINT) || ' Ip A1:1 C444alpha' || chr(10) AS head
        FROM (SELECT DISTINCT image_id // 5 AS anim_id, image_id % 5 AS fn FROM rgba_px) GROUP BY anim_id""",
    "starts": """SELECT *, row_number() OVER (PARTITION BY anim_id ORDER BY fn) - 1 AS nth
        FROM (SELECT DISTINCT image_id // 5 AS anim_id, image_id % 5 AS fn FROM rgba_px) JOIN heads USING (anim_id)""",
})

# ---- pages: what the added markup must give, worked out by hand per element ------

_BASE = """
    SELECT page_id, regexp_extract(url, '^[a-z]+:') AS scheme, regexp_extract(url, '^[a-z]+://[^/]+') AS origin,
      regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS bpath, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*/)', 1) AS folder,
      regexp_extract(url, '^[a-z]+://[^/]+((?:/[^/?#]+)*)/[^/?#]+/', 1) || '/' AS up FROM pages"""


def _elements(listed: str) -> str:
    rows = [
        (1, 0, "origin || '/img/' || page_id || '.jpg'", 800, 900, "'cover ' || page_id"),
        (1, 1, "origin || folder || 'big' || page_id || '.png'", 1200, 1600, "''"),
        (1, 2, "origin || folder || 'plain.jpg'", 0, 700, "''"),
        (1, 3, "origin || '/dup/' || page_id || '.png'", 100, 100, "''"),
        (1, 4, "origin || '/dup/' || page_id || '.png'", 900, 900, "'x > y'"),
        (1, 6, "origin || up || 'rel/' || page_id || '.webp'", 1000, 1000, "''"),
        (1, 7, "origin || bpath || '?v=' || page_id", 1000, 1000, "''"),
        (1, 8, f"origin || folder || '{listed}'", 1000, 1000, "''"),
        (1, 9, "origin || '/q' || page_id || '?a=1&b=2'", 1000, 1000, "(page_id || repeat('abcdefghij', 12))[1:100]"),
        (2, 0, "scheme || '//cdn.example.net/q' || page_id || '.avif'", 1000, 1000, "''"),
        (2, 1, "origin || folder || 'free.webp'", 1000, 1000, "''"),
        (3, 0, "origin || '/bg/' || page_id || '.jpg'", 900, 900, "''"),
    ]
    return " UNION ALL ".join(
        f"SELECT page_id, {phase} AS phase, {pos} AS pos, 0 AS sub, {url} AS url, {w} AS width, {h} AS height, {alt} AS alt FROM base"
        for phase, pos, url, w, h, alt in rows
    )


_ELEMENTS = {"base": _BASE, "elements": _elements("l2.jpg")}
add("img_candidates", "SELECT * FROM elements", _ELEMENTS)
add("img_candidates_strict", "SELECT * FROM elements", {"base": _BASE, "elements": _elements("l1.jpg 300w, l2.jpg 600w")})
add("filter_scheme", """
    SELECT page_id, phase, pos, sub, url FROM elements
    UNION ALL SELECT page_id, 9, pos, 0, ref FROM links_v WHERE pos % 2 = 1""", _ELEMENTS)
add("dedupe_urls", "SELECT * FROM elements WHERE NOT (phase = 1 AND pos = 4)", _ELEMENTS)
add("largest_first", "SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CAST(width AS BIGINT) * height DESC, phase, pos, sub) AS INTEGER) AS rank FROM elements WHERE NOT (phase = 1 AND pos = 4) AND width >= 400 AND height >= 600", _ELEMENTS)
add("write_manifest", """
    SELECT page_id, url, dest, count(*) OVER (PARTITION BY page_id, dest) AS n_sharing FROM (
      SELECT page_id, url, '/downloads/' || page_id || '/' || CASE WHEN contains(name, '.') THEN name
        ELSE 'image_' || md5(url)[1:8] || '.jpg' END AS dest
      FROM (SELECT *, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS name FROM elements
        WHERE NOT (phase = 1 AND pos = 4) AND width >= 400 AND height >= 600))""", _ELEMENTS)
