"""What each registered query must return, as SQL over the given tables."""

from __future__ import annotations

_EVENT_LOG = """
event_log AS (
  SELECT event_id AS pos, 'e' || event_id AS annotation_id,
    CASE WHEN value < 50 THEN 'preference' ELSE 'classification' END AS task_type,
    event_type AS label,
    CASE WHEN event_type = 'view' THEN '' WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END
      AS row_id,
    '{"day":"' || strftime(ts, '%Y-%m-%d') || '","user_id":' || user_id || '}' AS key_fields,
    strftime(ts, '%Y-%m-%d') AS row_hash,
    'u' || right(CAST(user_id AS VARCHAR), 1) AS annotator,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at
  FROM events)
"""

_INCOMING_LOG = _EVENT_LOG + """
, incoming_log AS (
  SELECT * FROM event_log
  UNION ALL
  SELECT o_orderkey + 1000000000000 AS pos,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
         WHEN o_orderpriority <> '5-LOW' THEN 'c' || o_custkey END AS annotation_id,
    'preference', o_orderstatus, CAST(o_custkey AS VARCHAR), '{}',
    strftime(o_orderdate, '%Y'), 'Clerk ' || left(o_orderpriority, 1),
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
  FROM orders)
, first_seen AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(annotation_id, 'None') ORDER BY pos) AS nth
  FROM incoming_log)
, new_records AS (
  SELECT * FROM first_seen
  WHERE annotation_id = ''
     OR (nth = 1 AND coalesce(annotation_id, 'None') NOT IN
           (SELECT coalesce(annotation_id, 'None') FROM event_log)))
"""

_FLAT = "pos, annotation_id, task_type, label, row_id, row_hash, annotator, created_at"

_ROW_KEY = "CASE WHEN row_id <> '' THEN row_id ELSE key_fields END"

_SPELLED = """
spelled AS (
  SELECT event_id AS pos,
    CASE WHEN user_id < 50 THEN 'preference' ELSE 'classification' END AS task_type,
    CASE WHEN value > 100 THEN upper(event_type) WHEN value > 50 THEN '  ' || event_type || ' '
         ELSE event_type END AS label
  FROM events)
, curated AS (
  SELECT CASE WHEN user_id < 50 THEN 'preference' ELSE 'classification' END AS task_type,
    upper(left(event_type, 1)) || substr(event_type, 2) AS label, min(event_id) AS pos
  FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
, spellings AS (
  SELECT task_type, lower(trim(label)) AS k, arg_min(trim(label), rank * 1000000000000 + pos) AS label,
    min(rank) AS rank, min(rank * 1000000000000 + pos) AS pos
  FROM (SELECT task_type, label, pos, 0 AS rank FROM curated
        UNION ALL SELECT task_type, label, pos, 1 FROM spelled)
  GROUP BY ALL)
, vocab AS (
  SELECT task_type, min(pos) AS pos, arg_min(trim(label), pos) AS label
  FROM spelled GROUP BY task_type, lower(trim(label)))
"""

_BRANDS = """
brands AS (SELECT p_type AS task_type, p_brand AS label, min(p_partkey) AS pos FROM part GROUP BY ALL)
, others AS (
  SELECT task_type, label, min(pos) AS pos FROM (
    SELECT p_type AS task_type, p_partkey AS pos,
      CASE WHEN contains(p_name, 'ring') THEN upper(p_brand) ELSE p_brand END AS label
    FROM part WHERE p_size <= 10
    UNION ALL SELECT 'segment', c_custkey, c_mktsegment FROM customer)
  GROUP BY ALL)
, label_list AS (
  SELECT task_type, label, min(pos) AS pos FROM (
    SELECT task_type, label, pos FROM brands
    UNION ALL
    SELECT o.task_type, o.label, o.pos + coalesce(b.used, 0) FROM others o
    LEFT JOIN (SELECT task_type, max(pos) + 1 AS used FROM brands GROUP BY ALL) b USING (task_type))
  GROUP BY ALL)
"""


def _codes(low: int, high: int, choose: str) -> str:
    edge = "min" if choose == "arg_min" else "max"
    return (
        f"SELECT p_type AS task_type, CAST(p_size AS VARCHAR) AS key, "
        f"{choose}(p_brand, p_partkey) AS label, {edge}(p_partkey) AS pos "
        f"FROM part WHERE p_size BETWEEN {low} AND {high} GROUP BY p_type, p_size"
    )


def _free_codes(labels: str, keys: str) -> str:
    """CTEs that give unkeyed labels the free codes in order."""
    return f"""
, waiting AS (
  SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY pos, label) AS place FROM {labels} l
  WHERE NOT EXISTS (SELECT 1 FROM {keys} k WHERE k.task_type = l.task_type AND k.label = l.label))
, free AS (
  SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY key) AS place
  FROM (SELECT DISTINCT task_type, CAST(n AS VARCHAR) AS key FROM {labels}, range(1, 10) r(n)) f
  WHERE NOT EXISTS (SELECT 1 FROM {keys} k WHERE k.task_type = f.task_type AND k.key = f.key))
, given AS (SELECT task_type, key, pos, label FROM waiting JOIN free USING (task_type, place))
"""


def _hash(pairs: str) -> str:
    return f"'sha256:' || sha256(CAST(to_json({{{pairs}}}) AS VARCHAR))"


_ORDER_JSON = (
    "o_custkey: o_custkey, o_orderdate: strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), "
    "o_orderkey: o_orderkey, o_orderpriority: o_orderpriority, o_orderstatus: o_orderstatus, "
    "o_totalprice: o_totalprice"
)
_ORDER_DATA = _ORDER_JSON.replace("%dT%H", "%d %H")
_DOCUMENT_JSON = "doc_id: doc_id, lang: lang, n_chars: n_chars, source: source, text: text"
_CUSTOMER_JSON = (
    "c_acctbal: c_acctbal, c_custkey: c_custkey, c_mktsegment: c_mktsegment, c_name: c_name, "
    "c_nationkey: c_nationkey"
)
_BALANCES = (
    "balances AS (SELECT * REPLACE (CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS "
    "c_acctbal) FROM customer)"
)
_LOOSE = """
loose_values AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN props
                        WHEN event_type <> 'view' THEN CAST(value AS VARCHAR) END AS loose FROM events)
"""
_FINGERPRINT = (
    "'sha256:' || sha256('{{\"config_name\":null,\"dataset_fingerprint\":\"' || "
    "sum(CAST(('0x' || substr(sha256(CAST(to_json({{{row}}}) AS VARCHAR)), 1, 15)) AS BIGINT)) || "
    "'\",\"dataset_name\":\"{name}\",\"row_count\":' || count(*) || ',\"split\":{split}}}')"
)

SQL: dict[str, str] = {
    "curation_page": f"""
        SELECT doc_id AS row_index, CAST(doc_id AS VARCHAR) AS row_id,
          CAST(to_json({{doc_id: doc_id, lang: lang}}) AS VARCHAR) AS key_fields,
          {_hash(_DOCUMENT_JSON)} AS row_hash
        FROM documents WHERE lang = 'en' AND contains(text, 'the')
        ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 200""",
    # sources
    "scan_csv": "SELECT * FROM documents",
    "scan_jsonl": "SELECT * FROM conversations",
    "scan_split": """
        SELECT *, CASE WHEN c_nationkey < 20 THEN 'train' ELSE 'validation' END AS split
        FROM customer""",
    "row_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    "row_index_parts": """
        SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders""",
    "row_index_csv": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    "row_index_jsonl": """
        SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events""",
    "dataset_fingerprint": "SELECT "
    + _FINGERPRINT.format(row=_DOCUMENT_JSON, name="documents", split='"train"')
    + " AS fingerprint FROM documents",
    "dataset_meta": f"""
        SELECT 'hf' AS source_type, 'customers' AS source_uri, 'train' AS split,
          (SELECT {_FINGERPRINT.format(row=_CUSTOMER_JSON, name="customers", split="null")} FROM customer)
            AS fingerprint,
          count(*) AS row_count, 'c_custkey' AS row_id_field,
          '["c_nationkey", "c_name"]' AS key_fields
        FROM customer""",
    # projection and identity
    "project_visible": "SELECT o_totalprice, o_orderkey FROM orders",
    "hide_columns": "SELECT * EXCLUDE (l_tax, l_shipdate, l_linestatus) FROM lineitem",
    "canonical_json": f"""
        WITH {_BALANCES}
        SELECT c_custkey, CAST(to_json({{{_CUSTOMER_JSON}}}) AS VARCHAR) AS row_json FROM balances""",
    "canonical_json_nested": """
        SELECT vec_id, CAST(to_json({dims: len(embedding), meta: {"inner": {label: label},
          z: [CAST(label AS BIGINT), vec_id]}, vec_id: vec_id}) AS VARCHAR) AS row_json
        FROM embeddings""",
    "canonical_json_vectors": """
        SELECT vec_id, embedding::DOUBLE[] AS embedding, '{"embedding":[' AS head FROM embeddings""",
    "row_hash": f"""
        SELECT 'documents' AS source, doc_id AS id, {_hash(_DOCUMENT_JSON)} AS row_hash FROM documents
        UNION ALL SELECT 'customer', c_custkey, {_hash(_CUSTOMER_JSON)} FROM customer
        UNION ALL SELECT 'pages', page_id, {_hash("html: html, page_id: page_id, url: url")} FROM pages""",
    "row_id": """
        SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN 's' || user_id
          ELSE CAST(event_id AS VARCHAR) END AS row_id FROM events""",
    "key_fields": f"""
        WITH {_BALANCES}
        SELECT c_custkey, CASE WHEN c_acctbal IS NULL
            THEN CAST(to_json({{c_nationkey: c_nationkey, c_name: c_name}}) AS VARCHAR)
            ELSE CAST(to_json({{c_nationkey: c_nationkey, c_acctbal: c_acctbal, c_name: c_name}})
              AS VARCHAR) END AS key_fields
        FROM balances""",
    "row_records": f"""
        SELECT o_orderkey AS row_index, CAST(o_orderkey AS VARCHAR) AS row_id,
          CAST(to_json({{o_custkey: o_custkey, o_orderstatus: o_orderstatus}}) AS VARCHAR) AS key_fields,
          {_hash(_ORDER_JSON)} AS row_hash, CAST(to_json({{{_ORDER_DATA}}}) AS VARCHAR) AS row_data
        FROM orders""",
    # filters
    "filter_eq": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "filter_ne": f"WITH {_BALANCES} SELECT * FROM balances WHERE c_acctbal <> 1863.84",
    "filter_range": """
        SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 24.5 AND l_discount <= 0.05
          AND l_orderkey > 1000.5""",
    "filter_dates": "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'",
    "filter_contains": "SELECT * FROM documents WHERE contains(text, 'the')",
    "filter_startswith": "SELECT * FROM part WHERE starts_with(p_name, 'small')",
    "filter_endswith": "SELECT * FROM part WHERE ends_with(p_name, 'ring')",
    "filter_and_or": """
        SELECT * FROM orders WHERE o_totalprice >= 200000 AND o_orderpriority = '1-URGENT'
          OR o_orderstatus = 'F'""",
    "filter_parens": """
        SELECT * FROM orders WHERE o_totalprice >= 200000
          AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'F')""",
    "filter_chain": """
        SELECT * FROM part WHERE p_size > 40 OR (p_brand = 'Brand#17' AND contains(p_name, 'ring'))""",
    "filtered_count": "SELECT count(*) AS row_count FROM customer WHERE c_acctbal > 0",
    "coerce_order": f"""
        WITH {_LOOSE} SELECT * FROM loose_values
        WHERE CASE WHEN TRY_CAST(loose AS DOUBLE) IS NOT NULL THEN TRY_CAST(loose AS DOUBLE) >= 50
                   ELSE loose >= '50' END""",
    "coerce_number": f"""
        WITH {_LOOSE} SELECT * FROM loose_values WHERE TRY_CAST(loose AS DOUBLE) < 50""",
    "coerce_ne": f"WITH {_LOOSE} SELECT * FROM loose_values WHERE loose IS DISTINCT FROM '12.31'",
    "coerce_null": f"WITH {_LOOSE} SELECT * FROM loose_values WHERE loose IS NULL",
    "coerce_lineitem": "SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_returnflag <> 'R'",
    # sort and page
    "sort_asc": "SELECT * FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey",
    "sort_desc": "SELECT * FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST",
    "view_rank": """
        SELECT c_custkey, band,
          row_number() OVER (ORDER BY band DESC NULLS LAST, c_custkey) - 1 AS place
        FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING'
                THEN CAST(floor(c_acctbal / 1000) AS BIGINT) END AS band
              FROM customer)""",
    "page": """
        SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 200 OFFSET 400""",
    "page_deep": """
        SELECT * FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber
        LIMIT 200 OFFSET (SELECT count(*) * 5 // 6 FROM lineitem)""",
    "page_of_parts": """
        SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_index, * FROM orders
        ORDER BY o_orderkey LIMIT 200 OFFSET 777""",
    "page_after": """
        SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200 OFFSET 200""",
    "page_at_row": """
        SELECT * FROM orders WHERE o_orderstatus = 'F'
        ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 200
        OFFSET (SELECT least(777, greatest(count(*) - 1, 0)) // 200 * 200 FROM orders
                WHERE o_orderstatus = 'F')""",
    "sample_rows": "SELECT * FROM documents ORDER BY doc_id LIMIT 5",
    # labels and annotations
    "annotate_rows": f"""
        SELECT sha256('["b1","preference","Click","alice","' || o_orderkey || '","' || row_hash
            || '","r1"]') AS annotation_id,
          'b1' AS bundle_id, 'sha256:f1' AS dataset_fingerprint, 'preference' AS task_type,
          'Click' AS label, '{{}}' AS payload, o_orderkey AS row_index,
          CAST(o_orderkey AS VARCHAR) AS row_id, '{{"o_custkey":' || o_custkey || '}}' AS key_fields,
          row_hash, row_data, 'alice' AS annotator, CAST(NULL AS VARCHAR) AS note,
          '2024-01-01T00:00:00Z' AS created_at, CAST(NULL AS VARCHAR) AS updated_at,
          'create' AS event_type
        FROM (SELECT *, {_hash(_ORDER_JSON)} AS row_hash,
                CAST(to_json({{{_ORDER_DATA}}}) AS VARCHAR) AS row_data FROM orders)
        WHERE o_totalprice >= 200000 AND o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'""",
    "resolve_labels": f"""
        WITH {_SPELLED}
        SELECT s.pos, s.task_type, v.label FROM spelled s JOIN spellings v
        ON s.task_type = v.task_type AND lower(trim(s.label)) = v.k""",
    "added_labels": f"""
        WITH {_SPELLED}
        SELECT task_type, pos - 1000000000000 AS pos, label FROM spellings WHERE rank = 1""",
    "label_vocab": f"WITH {_SPELLED} SELECT * FROM vocab",
    "label_folding": """
        SELECT task_type, min(pos) AS pos, arg_min(label, pos) AS label FROM (
          SELECT p_type AS task_type, p_partkey AS pos, p_brand,
            CASE p_size % 3 WHEN 0 THEN 'STRASSE ' WHEN 1 THEN 'Stra\u00dfe ' ELSE 'stra\u1e9ee ' END || p_brand AS label
          FROM part)
        GROUP BY task_type, p_brand""",
    "label_versions": """
        SELECT 'preference' AS task_type, label FROM (
          SELECT 'keep' AS label UNION SELECT 'o_orderstatus ' || o_orderstatus FROM orders
          UNION SELECT 'o_orderpriority ' || o_orderpriority FROM orders)""",
    "labels_by_task": f"WITH {_SPELLED} SELECT * FROM vocab WHERE task_type = 'preference'",
    "label_codes": f"""
        WITH {_BRANDS}, keyed AS ({_codes(1, 4, "arg_min")}) {_free_codes("brands", "keyed")}
        SELECT * FROM given""",
    "label_union": f"WITH {_BRANDS} SELECT task_type, pos, label FROM label_list",
    "label_code_merge": f"""
        WITH {_BRANDS}, target AS ({_codes(1, 3, "arg_min")}), source AS ({_codes(2, 6, "arg_max")})
        , keyed AS (
          SELECT * FROM target
          UNION ALL SELECT * FROM source s WHERE NOT EXISTS
            (SELECT 1 FROM target t WHERE t.task_type = s.task_type AND t.key = s.key))
        , shared AS (SELECT * FROM label_list WHERE task_type IN (SELECT task_type FROM brands))
        {_free_codes("shared", "keyed")}
        SELECT task_type, key, label FROM keyed UNION ALL SELECT task_type, key, label FROM given""",
    "annotation_count": f"WITH {_INCOMING_LOG} SELECT count(*) AS annotation_count FROM incoming_log",
    # merge
    "import_new": f"WITH {_INCOMING_LOG} SELECT {_FLAT} FROM new_records",
    "import_dedup_source": f"""
        WITH {_INCOMING_LOG} SELECT {_FLAT} FROM first_seen WHERE nth = 1 OR annotation_id = ''""",
    "import_merge": f"""
        WITH {_INCOMING_LOG}
        SELECT {_FLAT} FROM event_log UNION ALL SELECT {_FLAT} FROM new_records""",
    "import_report": f"""
        WITH {_INCOMING_LOG}
        , merged AS (SELECT * FROM event_log UNION ALL SELECT * EXCLUDE (nth) FROM new_records)
        SELECT (SELECT count(*) FROM incoming_log) AS source_count,
          (SELECT count(*) FROM event_log) AS existing_count,
          (SELECT count(*) FROM new_records) AS imported_count,
          (SELECT count(*) FROM incoming_log) - (SELECT count(*) FROM new_records) AS duplicate_count,
          (SELECT count(*) FROM (SELECT 1 FROM merged GROUP BY task_type, {_ROW_KEY}, row_hash
             HAVING count(DISTINCT label) > 1)) AS conflict_count""",
    "label_conflicts": f"""
        WITH {_EVENT_LOG}
        SELECT task_type, {_ROW_KEY} AS row_key, row_hash, min(label) AS lowest_label,
          max(label) AS highest_label
        FROM event_log GROUP BY ALL HAVING count(DISTINCT label) > 1""",
    "label_conflict_count": f"""
        WITH {_INCOMING_LOG}
        SELECT count(*) AS conflict_count FROM (
          SELECT 1 FROM incoming_log GROUP BY task_type, {_ROW_KEY}, row_hash
          HAVING count(DISTINCT label) > 1)""",
    "export_snapshot": f"""
        WITH {_EVENT_LOG}
        SELECT row_number() OVER (ORDER BY pos) - 1 AS position, annotation_id, task_type, label, row_id,
          annotator, created_at
        FROM event_log""",
    "import_bundle": f"""
        WITH {_INCOMING_LOG}
        , merged AS (SELECT * FROM event_log UNION ALL SELECT * EXCLUDE (nth) FROM new_records)
        SELECT true AS applied, (SELECT count(*) FROM incoming_log) AS source_count,
          (SELECT count(*) FROM event_log) AS existing_count, false AS label_set_changed,
          (SELECT count(*) FROM new_records) AS imported_count,
          (SELECT count(*) FROM incoming_log) - (SELECT count(*) FROM new_records) AS duplicate_count,
          (SELECT count(*) FROM (SELECT 1 FROM merged GROUP BY task_type, {_ROW_KEY}, row_hash
             HAVING count(DISTINCT label) > 1)) AS conflict_count,
          (SELECT count(*) FROM merged) AS written_count""",
    "known_ids": f"WITH {_INCOMING_LOG} SELECT DISTINCT i.annotation_id AS id FROM incoming_log i SEMI JOIN event_log e USING (annotation_id)",
    "merge_feed": f"""
        WITH {_INCOMING_LOG}
        SELECT * EXCLUDE (pos) FROM (
          SELECT {_FLAT} FROM event_log UNION ALL SELECT {_FLAT} FROM new_records)""",
    "annotate_bundle": """
        WITH status AS (SELECT 'Status-' || o_orderstatus AS label, count(*) AS n, min(o_orderkey) AS first
          FROM orders GROUP BY ALL),
        first_labels AS (SELECT label, row_number() OVER () AS code
          FROM (SELECT unnest(['high-quality', 'low-quality', 'needs-review', 'skip']) AS label))
        SELECT 'code' AS part, label, CAST(code AS VARCHAR) AS value FROM first_labels
        UNION ALL SELECT 'code', label, CAST(4 + row_number() OVER (ORDER BY first) AS VARCHAR) FROM status
        UNION ALL SELECT 'records', label, CAST(n AS VARCHAR) FROM status""",
    "filter_blank": "SELECT * FROM customer",
    "page_working_names": """
        SELECT o_orderkey AS _id, o_custkey AS _file, o_orderstatus AS _key, o_totalprice AS _part,
          o_orderdate, o_orderpriority
        FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200 OFFSET 1000""",
    "schema_listing": """
        SELECT * FROM (VALUES (0, 'event_id', 'bigint'), (1, 'ts', 'timestamp_ntz'), (2, 'user_id', 'bigint'),
          (3, 'event_type', 'string'), (4, 'value', 'double'), (5, 'props', 'string')) AS t(place, name, dtype)""",
    # summary
    "facet_filter": f"""
        WITH {_EVENT_LOG}
        SELECT {_FLAT} FROM event_log WHERE lower(trim(annotator)) = 'u3'
          AND lower(trim(task_type)) = 'preference'""",
    "facet_counts": f"""
        WITH {_INCOMING_LOG}
        SELECT 'label' AS facet, label AS value, count(*) AS records FROM incoming_log GROUP BY label
        UNION ALL SELECT 'annotator', annotator, count(*) FROM incoming_log GROUP BY annotator
        UNION ALL SELECT 'task_type', task_type, count(*) FROM incoming_log GROUP BY task_type""",
    "time_range": f"""
        WITH {_INCOMING_LOG}
        SELECT min(created_at) AS first_created_at, max(created_at) AS last_created_at
        FROM incoming_log""",
    "duplicate_ids": f"""
        WITH {_INCOMING_LOG}
        SELECT annotation_id, count(*) AS records FROM incoming_log WHERE annotation_id <> ''
        GROUP BY annotation_id HAVING count(*) > 1""",
    "conflicts_filtered": f"""
        WITH {_EVENT_LOG}
        SELECT count(*) AS conflict_count FROM (
          SELECT 1 FROM event_log WHERE annotator = 'u3' GROUP BY task_type, {_ROW_KEY}, row_hash
          HAVING count(DISTINCT label) > 1)""",
    "record_counts": f"""
        WITH {_EVENT_LOG}
        SELECT count(*) AS total_records, count(*) FILTER (label = 'click') AS filtered_records
        FROM event_log""",
    "sample_annotations": f"""
        WITH {_EVENT_LOG} SELECT {_FLAT} FROM event_log WHERE label = 'purchase' ORDER BY pos LIMIT 5""",
    "bundle_summary": f"""
        WITH {_INCOMING_LOG}, chosen AS (SELECT * FROM incoming_log WHERE task_type = 'preference')
        SELECT 'counts' AS section, 'total_records' AS name, CAST(count(*) AS VARCHAR) AS value
          FROM incoming_log
        UNION ALL SELECT 'counts', 'filtered_records', CAST(count(*) AS VARCHAR) FROM chosen
        UNION ALL SELECT 'stats', 'first_created_at', min(created_at) FROM chosen
        UNION ALL SELECT 'stats', 'last_created_at', max(created_at) FROM chosen
        UNION ALL SELECT 'counts', 'duplicate_annotation_ids', CAST(count(*) AS VARCHAR) FROM (
          SELECT 1 FROM chosen WHERE annotation_id <> '' GROUP BY annotation_id HAVING count(*) > 1)
        UNION ALL SELECT 'counts', 'row_label_conflicts', CAST(count(*) AS VARCHAR) FROM (
          SELECT 1 FROM chosen GROUP BY task_type, {_ROW_KEY}, row_hash
          HAVING count(DISTINCT label) > 1)
        UNION ALL SELECT 'by_label', label, CAST(count(*) AS VARCHAR) FROM chosen GROUP BY label
        UNION ALL SELECT 'by_annotator', annotator, CAST(count(*) AS VARCHAR) FROM chosen
          GROUP BY annotator
        UNION ALL SELECT 'by_task_type', task_type, CAST(count(*) AS VARCHAR) FROM chosen
          GROUP BY task_type""",
    # text functions
    "cell_preview": """
        SELECT doc_id,
          CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS text,
          CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "cell_text": f"""
        WITH {_BALANCES}
        SELECT c_custkey, coalesce(CAST(c_acctbal AS VARCHAR), 'null') AS balance,
          '{{' || chr(10) || '  "c_mktsegment": "' || c_mktsegment || '",' || chr(10)
            || '  "c_nationkey": ' || c_nationkey || chr(10) || '}}' AS place
        FROM balances""",
    "slugify": """
        SELECT p_partkey, lower(trim(regexp_replace(p_name || ' / ' || p_brand, '[^a-zA-Z0-9]+', '_', 'g'),
          '_')) AS slug FROM part""",
}
SQL["page_at_rank"] = SQL["page_at_row"]

_TOLD = {
    ("manifest", "schema_version"): "1.0", ("manifest", "dataset.source_type"): "hf", ("manifest", "dataset.source_uri"): "null",
    ("manifest", "dataset.split"): "null", ("manifest", "dataset.fingerprint"): "sha256:f1", ("manifest", "dataset.row_id_field"): "null",
    ("manifest", "dataset.key_fields"): "[]", ("filters", "task_type"): "PREFERENCE", ("label_set", "active_task_type"): "preference",
    ("labels.preference", "0"): "Click", ("labels.preference", "1"): "view",
    ("hotkeys.preference", "1"): "Click", ("hotkeys.preference", "2"): "view",
}
_VALUES = ", ".join(str((*name, value)) for name, value in _TOLD.items())
SQL["bundle_report"] = f"""{SQL["bundle_summary"]}
        UNION ALL FROM (VALUES {_VALUES})
        UNION ALL FROM (
          SELECT 'sample_records', CAST(place AS VARCHAR), annotation_id FROM (
            SELECT *, row_number() OVER (ORDER BY pos) - 1 AS place FROM incoming_log)
          WHERE task_type = 'preference' ORDER BY place LIMIT 3)"""
SQL["growing_fingerprint"] = SQL["dataset_fingerprint"].replace(" AS fingerprint FROM", " AS fingerprint, true AS changed FROM")
SQL["growing_conflicts"] = f"""
        WITH {_EVENT_LOG}
        SELECT task_type, {_ROW_KEY} AS row_key, row_hash, min(label) AS lowest_label,
          max(label) AS highest_label, appends
        FROM event_log, (VALUES (1), (2), (3)) AS a(appends) WHERE pos % 3 < appends
        GROUP BY ALL HAVING count(DISTINCT label) > 1"""
SQL["import_steps"] = f"""
        WITH {_INCOMING_LOG}
        , sizes AS (SELECT (SELECT count(*) FROM event_log) AS old, (SELECT count(*) FROM new_records) AS new)
        SELECT 'refused' AS step, false AS applied, 0 AS records, false AS label_set_changed, old AS held FROM sizes
        UNION ALL SELECT 'tried', false, new, true, old FROM sizes
        UNION ALL SELECT 'imported', true, new, true, old + new FROM sizes
        UNION ALL SELECT 'labels', true, 3, false, old + new FROM sizes"""
SQL["sort_mixed"] = """
        SELECT event_id, row_number() OVER (
          ORDER BY '{"event_type":"' || event_type || '","user_id":' || user_id || '}', event_id) - 1 AS place
        FROM events"""
SQL["scan_by_suffix"] = """
        SELECT kind, c_custkey, c_acctbal, c_name FROM customer, (VALUES ('csv'), ('jsonl'), ('hf')) AS k(kind)"""
SQL["inspect_rows"] = """
        SELECT doc_id AS row_index, CAST(doc_id AS VARCHAR) AS row_id, '{"lang":"' || lang || '"}' AS key_fields,
          (SELECT count(*) FROM documents) AS row_count
        FROM documents ORDER BY doc_id LIMIT 5"""
