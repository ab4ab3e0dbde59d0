"""The same results in plain SQL for DuckDB, to check the queries against."""

from __future__ import annotations

from fieldloom import catalog
from fieldloom.functions.infer import MOMENT_TEXT, NUMERIC_TEXT
from fieldloom.plans import queries as Q

AS_OF = f"TIMESTAMP '{Q.AS_OF:%Y-%m-%d %H:%M:%S}'"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def case(rules, subject: str, before: str = "") -> str:
    whens = " ".join(f"WHEN regexp_matches({subject}, {text(before.format(p) if before else p)}) THEN {text(v)}" for p, v in rules)
    return f"CASE {whens} END"


def values(rows) -> str:
    def one(v):
        return text(v) if isinstance(v, str) or v is None else repr(float(v)) + "::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def hash_bucket(token: str, size: int) -> str:
    step, out = (1 << 32) % size, "0"
    for part in range(4):
        out = f"(({out}) * {step} + ('0x' || substr(md5({token}), {part * 8 + 1}, 8))::BIGINT) % {size}"
    return out


WORDS = catalog.vocabulary()
SIZE = max(len(WORDS), 32)
# DuckDB rounds by a product, which spoils large numbers such as epoch times
SIX = "CASE WHEN abs({0}) > 1e9 THEN {0} ELSE round({0}, 6) END"

# name -> (needs, sql)
CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], "SELECT *, json_extract_string(props, '$.k') AS k FROM events"),
    "message": (["ev"], """
        SELECT 'evt-' || event_id AS message_id, 'user-' || user_id AS device_id, event_type, ts,
        CASE event_type WHEN 'click' THEN 'MQTT' WHEN 'view' THEN 'HTTP' WHEN 'purchase' THEN 'CoAP' WHEN 'signup' THEN 'OPC-UA' WHEN 'error' THEN 'WebSocket' END AS protocol,
        'devices/user-' || user_id || '/' || event_type AS topic, value AS v,
        CASE event_type
          WHEN 'click' THEN '{"temp_c":' || value || ',"humidity_pct":' || k || ',"device_id":"user-' || user_id || '"}'
          WHEN 'view' THEN '{"temperature_f":' || value || ',"rh":' || k || ',"pressure_hpa":1013.25,"station_id":"user-' || user_id || '"}'
          WHEN 'purchase' THEN '{"readings":{"temperature":{"value":' || value || ',"unit":"K"},"co2_ppm":' || k || '},"serial":"IND-' || user_id || '","ts":' || (1704067200 + event_id) || '}'
          WHEN 'signup' THEN '{"voltage":' || value || ',"power_w":' || k || ',"ts":' || (1704067200000 + event_id) || '}'
          WHEN 'error' THEN '{"lat":' || value || ',"lng":-' || k || ',"speed_kmh":' || value || ',"timestamp":"2024-01-15T10:30:00Z"}' END AS payload
        FROM ev"""),
    "leaf": (["message"], """
        SELECT message_id, device_id, protocol, topic, ts, substr(t.fullkey, 3) AS key, t.type AS jtype,
        row_number() OVER (PARTITION BY message_id ORDER BY t.id) - 1 AS pos,
        CASE WHEN t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (t.value ->> '$')::DOUBLE END AS num_value,
        CASE WHEN t.type = 'VARCHAR' THEN t.value ->> '$' END AS str_value
        FROM message, json_tree(payload) t WHERE t.type NOT IN ('OBJECT', 'NULL')"""),
    "field0": (["leaf"], f"""
        SELECT *, CASE WHEN jtype IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN jtype = 'DOUBLE' THEN 'float'
        WHEN {' OR '.join(f"regexp_matches(str_value, {text(p)})" for p in catalog.ISO_PATTERNS)} THEN 'datetime'
        WHEN regexp_matches(str_value, {text(NUMERIC_TEXT)}) THEN 'numeric_string' ELSE 'string' END AS value_type,
        lower(key) AS lk FROM leaf"""),
    "field": (["field0"], f"""
        SELECT * EXCLUDE (lk), regexp_matches(lk, '{'|'.join(catalog.TIMESTAMP_WORDS)}') OR value_type = 'datetime'
        OR coalesce((num_value > 1e9 AND num_value < 1e10) OR (num_value > 1e12 AND num_value < 1e13), false) AS is_timestamp,
        regexp_matches(lk, '^(?:{'|'.join(catalog.IDENTIFIER_WORDS)})|(?:{'|'.join(catalog.IDENTIFIER_WORDS)})$')
        OR coalesce(regexp_matches(lower(str_value), {text(catalog.UUID_PATTERN)}), false) AS is_identifier,
        {case(catalog.UNIT_PATTERNS, 'lk', '^(?:{})')} AS inferred_unit, {case(catalog.HINT_PATTERNS, 'lk')} AS inferred_semantic
        FROM field0"""),
    "sig": (["message", "field"], """
        SELECT m.message_id, m.device_id, m.protocol, m.topic, m.ts, m.event_type, m.payload,
        substr(sha256(coalesce(string_agg(f.key || ':' || f.value_type, '|' ORDER BY f.key || ':' || f.value_type)
          FILTER (WHERE NOT f.is_timestamp AND NOT f.is_identifier), '')), 1, 16) AS schema_signature
        FROM message m LEFT JOIN field f USING (message_id) GROUP BY ALL"""),
    "sfield": (["sig", "field"], """
        SELECT DISTINCT schema_signature, key, is_timestamp OR is_identifier AS flagged, inferred_unit, inferred_semantic
        FROM field JOIN sig USING (message_id)"""),
    "nm": (["sfield"], "SELECT DISTINCT key, inferred_semantic, inferred_unit FROM sfield WHERE NOT flagged"),
    "vocab": ([], f"SELECT * FROM (VALUES {values((w, i) for i, w in enumerate(WORDS))}) t(token, idx)"),
    "concept": ([], f"SELECT * FROM (VALUES {values((i, c[0], c[1], c[2], c[3], ' '.join(c[4]), len(c[4])) for i, c in enumerate(catalog.CONCEPTS))}) t(ordinal, concept_id, description, unit, datatype, aliases, n_aliases)"),
    "alias": ([], f"SELECT * FROM (VALUES {values((i, a.alias, a.concept_id, a.unit) for i, a in enumerate(catalog.aliases()))}) t(aord, alias, concept_id, unit)"),
    "cname": ([], """SELECT lower(c_mktsegment) || '.m' || c_custkey AS key, lower(c_mktsegment) || '_m' || c_custkey AS low, c_mktsegment || '-' || c_nationkey AS schema_signature, c_custkey AS pos,
        CASE c_custkey % 4 WHEN 0 THEN 'size_' || c_custkey % 50 WHEN 1 THEN 'x_m' || c_custkey || '_y' WHEN 2 THEN 'hot_' || c_custkey % 7 || '_gear' END AS hint FROM customer"""),
    "palias": ([], """SELECT p_partkey AS ordinal, 'part_' || p_partkey AS concept_id, lower(p_brand) AS unit, unnest([0, 1, 2]) AS place,
        unnest(['m' || p_partkey, 'size_' || p_size || '_' || p_partkey, replace(p_name, ' ', '_')]) AS alias FROM part"""),
    "qtok": (["nm", "vocab"], f"""
        SELECT key, coalesce(idx, {hash_bucket('tok', SIZE)}) AS bucket, max(CASE WHEN idx IS NULL THEN 0.3 ELSE 1.0 END::DOUBLE) AS w
        FROM (SELECT key, unnest(list_distinct(regexp_split_to_array(lower(key || ' ' || coalesce(inferred_semantic, '') || ' ' || coalesce(inferred_unit, '')), '[\\s_./-]+'))) AS tok FROM nm)
        LEFT JOIN vocab ON token = tok GROUP BY 1, 2"""),
    "qvec": (["qtok"], "SELECT key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM qtok"),
    "ctok": (["concept", "vocab"], f"""
        SELECT ordinal, concept_id, unit, coalesce(idx, {hash_bucket('tok', SIZE)}) AS bucket, max(CASE WHEN idx IS NULL THEN 0.3 ELSE 1.0 END::DOUBLE) AS w
        FROM (SELECT ordinal, concept_id, unit, unnest(list_distinct(regexp_split_to_array(lower(concept_id || ' ' || description || ' ' || aliases), '[\\s_./-]+'))) AS tok FROM concept)
        LEFT JOIN vocab ON token = tok GROUP BY ALL"""),
    "cvec": (["ctok"], "SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY concept_id)) AS cw FROM ctok"),
    "best": (["qvec", "cvec"], """
        SELECT key, concept_id, unit, similarity FROM (
          SELECT key, ordinal, concept_id, unit, round(sum(weight * cw), 12) AS similarity FROM qvec JOIN cvec USING (bucket) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY similarity DESC, ordinal) = 1"""),
    "open": (["field", "sig", "best"], f"""
        SELECT e.schema_signature, e.message_id, f.key, f.pos, f.inferred_semantic AS h FROM (SELECT schema_signature, min(message_id) AS message_id FROM sig GROUP BY 1) e JOIN field f USING (message_id)
        WHERE NOT (f.is_timestamp OR f.is_identifier) AND f.key NOT IN (SELECT key FROM best WHERE similarity >= {catalog.SIMILARITY_THRESHOLD})"""),
    "ruled": (["nm", "alias"], """
        SELECT key, concept_id, unit FROM (
          SELECT key, concept_id, unit, aord, CASE WHEN contains(lower(inferred_semantic), alias) OR contains(alias, lower(inferred_semantic)) THEN 0 ELSE 1 END AS stage
          FROM nm JOIN alias ON contains(lower(inferred_semantic), alias) OR contains(alias, lower(inferred_semantic)) OR contains(replace(lower(key), '.', '_'), alias))
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, aord) = 1"""),
    "target": (["best", "ruled", "nm"], f"""
        SELECT nm.key, coalesce(b.concept_id, r.concept_id) AS concept, coalesce(b.unit, r.unit) AS unit,
        coalesce(b.similarity, 0.7) AS confidence, CASE WHEN b.key IS NULL THEN 'llm' ELSE 'embedding' END AS method
        FROM nm LEFT JOIN (SELECT * FROM best WHERE similarity >= {catalog.SIMILARITY_THRESHOLD}) b USING (key) LEFT JOIN ruled r USING (key)"""),
    "mapping": (["sfield", "target"], """
        SELECT schema_signature, key, '_' || coalesce(inferred_semantic, 'passthrough') AS target_concept, key AS target_field,
        inferred_unit AS source_unit, inferred_unit AS target_unit, 1.0::DOUBLE AS confidence, 'passthrough' AS resolution_method FROM sfield WHERE flagged
        UNION ALL SELECT schema_signature, s.key, concept, concept, s.inferred_unit, t.unit, confidence, method
        FROM sfield s JOIN target t USING (key) WHERE NOT flagged AND concept IS NOT NULL"""),
    "overall": (["sfield", "mapping", "target"], """
        SELECT s.schema_signature, c.confidence, coalesce(l.llm, false) AS llm_generated, CASE WHEN l.llm THEN 'unknown' END AS device_context
        FROM (SELECT DISTINCT schema_signature FROM sfield) s LEFT JOIN (
          SELECT schema_signature, sum(confidence * w) / sum(w) AS confidence FROM (
            SELECT *, CASE resolution_method WHEN 'embedding' THEN 1.0 WHEN 'llm' THEN 0.9 END::DOUBLE AS w FROM mapping) GROUP BY 1) c USING (schema_signature)
        LEFT JOIN (SELECT schema_signature, bool_or(method <> 'embedding') AS llm FROM sfield JOIN target USING (key) WHERE NOT flagged GROUP BY 1) l USING (schema_signature)"""),
    "conv": ([], f"SELECT * FROM (VALUES {values((i, *c) for i, c in enumerate(catalog.CONVERSIONS))}) t(ordinal, from_unit, to_unit, pre, mul, div, post)"),
    "limits": ([], f"SELECT * FROM (VALUES {values(catalog.CONSTRAINTS)}) t(target_concept, datatype, min_value, max_value)"),
    "mapped": (["field", "sig", "mapping", "conv", "limits"], """
        SELECT f.*, s.schema_signature, m.target_concept, m.target_field, m.source_unit, m.target_unit, m.resolution_method,
        l.datatype, l.min_value, l.max_value, coalesce(num_value, try_cast(CASE WHEN value_type = 'numeric_string' THEN str_value END AS DOUBLE)) AS num,
        round((coalesce(num_value, try_cast(CASE WHEN value_type = 'numeric_string' THEN str_value END AS DOUBLE)) + pre) * mul / div + post, 6) AS converted
        FROM field f JOIN sig s USING (message_id) LEFT JOIN mapping m ON m.schema_signature = s.schema_signature AND m.key = f.key
        LEFT JOIN conv c ON c.from_unit = m.source_unit AND c.to_unit = m.target_unit LEFT JOIN limits l ON l.target_concept = m.target_concept"""),
    "checked": (["mapped"], """
        SELECT *, CASE WHEN datatype = 'float' THEN coalesce(converted, num) END AS typed_number,
        coalesce(datatype = 'float' AND coalesce(converted, num) IS NULL, false) AS type_failed,
        coalesce(CASE WHEN datatype = 'float' THEN coalesce(converted, num) < min_value OR coalesce(converted, num) > max_value END, false) AS out_of_range
        FROM mapped"""),
    "normal": (["checked"], """
        SELECT *, CASE WHEN target_field IS NULL THEN 'unmapped' WHEN type_failed THEN 'type_mismatch' WHEN out_of_range THEN 'out_of_range' ELSE 'ok' END AS status,
        CASE WHEN target_field IS NULL THEN '_unmapped.' || key WHEN type_failed THEN '_error.' || target_field
          WHEN out_of_range THEN '_invalid.' || target_field ELSE target_field END AS out_key,
        CASE WHEN target_field IS NOT NULL AND NOT type_failed AND NOT out_of_range THEN
          CASE WHEN converted IS NOT NULL OR datatype = 'float' OR (value_type = 'float' AND datatype IS NULL) THEN
            round(coalesce(typed_number, converted, num_value), CASE WHEN contains(target_field, 'float') THEN 6 WHEN contains(target_field, 'temperature') THEN 2 WHEN contains(target_field, 'percentage') THEN 1 ELSE 6 END)
          ELSE num_value END END AS metric_value
        FROM checked"""),
    "kept": (["normal"], "SELECT * FROM normal QUALIFY row_number() OVER (PARTITION BY message_id, out_key ORDER BY pos DESC) = 1"),
    "moments": (["field"], f"""
        SELECT message_id, min_by(t, pos) AS t FROM (SELECT message_id, pos, CASE WHEN regexp_matches(str_value, {text(MOMENT_TEXT)}) THEN try_cast(replace(replace(str_value, 'Z', ''), 'T', ' ') AS TIMESTAMP)
        WHEN num_value IS NOT NULL THEN make_timestamp((CASE WHEN num_value > 1e12 THEN num_value / 1000 ELSE num_value END * 1000000)::BIGINT) END AS t
        FROM field WHERE is_timestamp) WHERE t IS NOT NULL GROUP BY 1"""),
    "done": (["sig", "overall", "moments"], """
        SELECT s.*, o.confidence, o.llm_generated, o.device_context AS context, coalesce(t.t, s.ts) AS event_time, t.t IS NULL AS fallback
        FROM sig s LEFT JOIN overall o USING (schema_signature) LEFT JOIN moments t USING (message_id)"""),
    "metric": (["kept", "done"], """
        SELECT d.event_time AS time, d.device_id, k.out_key AS metric, k.metric_value AS value, d.message_id
        FROM kept k JOIN done d USING (message_id) WHERE metric_value IS NOT NULL AND NOT starts_with(out_key, '_')"""),
    "shown": (["kept"], """
        SELECT message_id, out_key AS name, coalesce(CASE WHEN status = 'ok' THEN metric_value ELSE coalesce(typed_number, converted) END, num_value, try_cast(str_value AS DOUBLE)) AS number, str_value AS text FROM kept"""),
    "property": (["done"], """
        SELECT message_id, name, number, text FROM (SELECT message_id,
          unnest(['source_protocol', 'source_topic', 'translation_confidence', 'schema_signature', 'inferred_context', 'llm_assisted']) AS name,
          unnest([NULL, NULL, round(confidence, 6), try_cast(schema_signature AS DOUBLE), NULL, NULL]) AS number,
          unnest([protocol, topic, NULL, CASE WHEN try_cast(schema_signature AS DOUBLE) IS NULL THEN schema_signature END, context, CASE WHEN llm_generated THEN 'true' END]) AS text FROM done)
        WHERE number IS NOT NULL OR text IS NOT NULL"""),
    "day": (["sig"], """
        SELECT schema_signature, min(ts) AS created_at, count(*) AS hit_count FROM sig GROUP BY schema_signature, date_trunc('day', ts)"""),
    "dayfields": (["day", "sig", "field"], """
        SELECT d.schema_signature, d.created_at, d.hit_count, f.key, f.value_type FROM day d
        JOIN (SELECT schema_signature, date_trunc('day', ts) AS dd, min_by(message_id, (ts, message_id)) AS message_id FROM sig GROUP BY 1, 2) x
        ON x.schema_signature = d.schema_signature AND x.dd = date_trunc('day', d.created_at) JOIN field f USING (message_id)"""),
    "seeded": (["day"], """
        SELECT * FROM day QUALIFY row_number() OVER (PARTITION BY schema_signature ORDER BY created_at DESC) = 1"""),
    "live": (["seeded"], f"SELECT * FROM seeded WHERE {AS_OF} - created_at < INTERVAL 15 DAY"),
    "device": ([], f"""
        SELECT 'user-' || c_custkey AS device_id, lower(c_mktsegment) AS type, c_name AS name, n_name AS location,
        'customer,' || c_mktsegment AS tags, c_mktsegment AS segment, {AS_OF} AS updated_at FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""),
    "fan": (["message"], f"""
        SELECT message_id, payload, v, output, target FROM (SELECT m.*, unnest(['kafka', 'mqtt', 'http', 'http', 'websocket', 'timescale']) AS output,
        unnest(['iot.normalized.general', 'normalized/' || device_id, '{Q.ENDPOINTS[0]}', '{Q.ENDPOINTS[1]}', 'devices/' || device_id, 'iot_metrics']) AS target FROM message m)"""),
    "delivery": (["fan"], """
        SELECT *, CASE output WHEN 'http' THEN v < 300 WHEN 'kafka' THEN v < 400 WHEN 'mqtt' THEN v < 450 ELSE true END AND (v < 480 OR output <> 'websocket') AS ok FROM fan"""),
    "reply": ([], """
        SELECT event_id, event_type, user_id, value, CASE event_type WHEN 'click' THEN 'temperature_celsius' WHEN 'view' THEN 'speed_mps' WHEN 'purchase' THEN '_private' END AS concept FROM events"""),
    "received": ([], "SELECT ts AS time, 'user-' || user_id AS device_id, event_type AS metric, value, 'evt-' || event_id AS message_id FROM events"),
    "nested": ([], r"""SELECT l_orderkey || '-' || l_linenumber AS id, l_linenumber AS n, '{"t":"a[{\"é' || l_returnflag || '","n":' || repeat('{"d":[', l_linenumber) || l_quantity || repeat(']}', l_linenumber) || '}' AS payload FROM lineitem"""),
    "outcome": (["sig", "normal", "device"], """
        SELECT s.message_id, s.protocol, d.type AS device_type, e.error_type, e.error_type IS NOT NULL AS failed FROM sig s
        LEFT JOIN (SELECT message_id, min_by(status, pos) AS error_type FROM normal WHERE status IN ('type_mismatch', 'out_of_range') GROUP BY 1) e USING (message_id)
        LEFT JOIN device d USING (device_id)"""),
    "measure": ([], f"""
        SELECT l_quantity, (['{"', '".join(dict.fromkeys(c[0] for c in catalog.CONVERSIONS))}'])[1 + (l_orderkey % {len(dict.fromkeys(c[0] for c in catalog.CONVERSIONS))})] AS from_unit FROM lineitem"""),
}


def with_ctes(select: str, *names: str) -> str:
    wanted: set[str] = set()

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        wanted.add(name)

    for name in names:
        need(name)
    parts = [f"{name} AS ({sql})" for name, (_, sql) in CTES.items() if name in wanted]
    return f"WITH {', '.join(parts)} {select}" if parts else select


# the exact sum of the printed values, so that the order of the rows cannot show
ROLLUP = "sum(value::VARCHAR::DECIMAL(38,12))::DOUBLE / count(*) AS a, min(value) AS lo, max(value) AS hi, count(*) AS n"
ROLLUP_OUT = f"{TS.format('bucket')} AS bucket, device_id, metric, a AS avg_value, {SIX.format('lo')} AS min_value, {SIX.format('hi')} AS max_value, n AS sample_count"
DOCS = "SELECT 'doc-' || doc_id AS id, text FROM documents"
TURNS = "SELECT 'turn-' || conv_id || '-' || turn AS id, text FROM conversations"
PAGES = "SELECT 'page-' || page_id AS id, html AS text FROM pages"
XML = """'{"@attributes": {"id": "' || l_orderkey || '", "n": "' || l_linenumber || '"}, "q": "' || l_quantity || '", "p": {"@attributes": {"k": "d"}, "#text": "' || l_discount || '"}, "v": ["1", "' || l_linenumber || '"], "e": {}}'"""
CSV = r"""CASE WHEN o_orderkey % 2 = 0 THEN '{"rows":[{"key":"' || o_orderkey || '","status":"' || o_orderstatus || '","note":"a, \"b\""},{"key":"' || o_custkey || '","status":"x","note":null}],"_count":2}'
  ELSE '{"key":"' || o_orderkey || '","status":"' || o_orderstatus || '","note":"a, \"b\""}' END"""
REG = """'{"registers":[' || (l_orderkey % 65536) || ',' || l_linenumber || ',127],"_count":3}'"""
EVENT_SIG = "'sig-' || event_id"
UNICODE = {r"\w": r"[\p{L}\p{M}\p{N}_]", r"\s": r"[\s\v\p{Z}\x1c-\x1f\x{85}]", r"\d": r"\p{Nd}"}
SPACES = r"[\s\v\p{Z}\x1c-\x1f\x{85}]"


def re2(pattern: str) -> str:
    for short, long in UNICODE.items():
        pattern = pattern.replace(short, long)
    return pattern


def subscription(pattern: str) -> str:
    from fieldloom.sources.messages import subscription_regex

    return subscription_regex(pattern)


THREATS = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(text), {text(re2(p))}) THEN {text(f'{family} pattern detected: {p}')}" for family, p in catalog.THREAT_PATTERNS
) + " END"
TOKENS = r"regexp_split_to_array(lower({}), '[\s_./-]+')"
FORMULA_SQL = {
    "(value - 32) * 5/9": "(num - 32) * 5 / 9",
    "value / 3.6": "num / 3.6",
    "value * 2 + 1": "num * 2 + 1",
    "value ** 2": "NULL",
    "value / 0": "NULL",
}
TOPIC_OK = r"regexp_matches(topic, '^[a-zA-Z0-9/+#._\-]+$') AND NOT contains(topic, '..')"
NUM = "CASE WHEN regexp_matches(raw, " + text(NUMERIC_TEXT) + ") THEN try_cast(trim(raw) AS DOUBLE) END"
VECTORS = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"

ORACLES: dict[str, str] = {
    "a1_read_messages": with_ctes(f"SELECT message_id, device_id, protocol, topic, payload, {TS.format('ts')} AS received FROM message", "message"),
    "a2_stream_messages": with_ctes(f"SELECT message_id, device_id, protocol, topic, payload, {TS.format('ts')} AS received FROM message", "message"),
    "a3_merge_protocols": with_ctes("SELECT message_id, protocol, topic FROM message", "message"),
    "a4_match_subscriptions": with_ctes(f"SELECT message_id, topic, {case([(subscription(p), p) for p in Q.SUBSCRIPTIONS], 'topic')} AS subscription FROM message", "message"),
    # the filters as regular expressions, each topic against each
    "a4_subscription_table": with_ctes(r"""SELECT message_id, topic, pattern AS subscription FROM message LEFT JOIN (
        SELECT topic, arg_min(pattern, ordinal) AS pattern FROM (SELECT DISTINCT topic FROM message) JOIN (
          SELECT ordinal, pattern, '^' || replace(CASE WHEN suffix(pattern, '/#') THEN pattern[:-3] || '(/.*)?' ELSE pattern END, '+', '[^/]*') || '$' AS re FROM (
            SELECT ordinal, CASE user_id % 6 WHEN 0 THEN 'devices/user-' || user_id || '/#' WHEN 1 THEN 'devices/user-' || user_id || '/' || event_type WHEN 2 THEN '+/user-' || user_id || '/+'
              WHEN 3 THEN 'devices/user-' || user_id || '/' || event_type || '/#' WHEN 4 THEN 'devices/user-' || user_id ELSE 'devices/user-' || user_id || '#/' || event_type END AS pattern
            FROM (SELECT user_id, event_type, min(event_id) AS ordinal FROM events GROUP BY ALL)
            UNION ALL SELECT min(event_id) + 1000000000, 'devices/+/' || event_type FROM events WHERE event_type <> 'error' GROUP BY event_type)) ON regexp_matches(topic, re)
        GROUP BY topic) USING (topic)""", "message"),
    "a5_derive_device_id": with_ctes("""SELECT id, topic, coalesce(""" + ", ".join(
        f"nullif(regexp_extract(topic, '(?i){p}', 1), '')" for p in catalog.DEVICE_ID_PATTERNS) + """,
        list_filter(string_split(topic, '/'), lambda x: x <> '')[-1], 'unknown') AS device_id FROM (
        SELECT message_id AS id, topic FROM message UNION ALL SELECT 'page-' || page_id, url FROM pages UNION ALL SELECT 'doc-' || doc_id, 'Sensors/' || source || '/data' FROM documents)""", "message"),
    "a6_classify_encoding": with_ctes(r"""SELECT id, CASE WHEN payload = '' THEN 'binary' WHEN json_valid(payload) THEN 'json'
        WHEN list_bool_or(list_transform([',', ';', chr(9)], lambda m: list_min(list_transform(lines, lambda x: length(x) - length(replace(x, m, '')))) > 0
          AND len(list_distinct(list_transform(lines, lambda x: length(x) - length(replace(x, m, ''))))) = 1)) THEN 'csv' ELSE 'binary' END AS payload_encoding
        FROM (SELECT id, payload, string_split(trim(payload, ' ' || chr(9) || chr(13) || chr(10)), chr(10)) AS lines FROM (
          SELECT message_id AS id, payload FROM message UNION ALL SELECT 'doc-' || doc_id, text FROM documents
          UNION ALL SELECT 'customer-' || c_custkey, 'key;name;segment' || chr(10) || c_custkey || ';' || c_name || CASE WHEN c_custkey % 3 > 0 THEN ';' || c_mktsegment ELSE '' END || chr(10) FROM customer)
        WHERE NOT starts_with(ltrim(payload), '<'))""", "message"),
    "a7_decode_json": with_ctes("""SELECT id, md5(d) AS document_md5, length(d)::BIGINT AS chars FROM (SELECT id,
        CASE WHEN json_valid(p) THEN CASE WHEN json_type(p) = 'OBJECT' THEN p ELSE '{"value":' || p || '}' END ELSE '{"_raw":"' || lower(hex(encode(p))) || '"}' END AS d
        FROM (SELECT message_id AS id, payload AS p FROM message UNION ALL SELECT 'doc-' || doc_id, text FROM documents UNION ALL SELECT 'order-' || o_orderkey, '[' || o_orderkey || ',7]' FROM orders))""", "message"),
    "a8_decode_xml": f"SELECT l_orderkey, l_linenumber, {XML} AS document FROM lineitem",
    "a9_decode_csv": f"SELECT o_orderkey, {CSV} AS document FROM orders",
    "a10_decode_registers": f"SELECT l_orderkey, l_linenumber, {REG} AS document FROM lineitem",
    "a11_decode_binary": """SELECT doc_id, md5('{"raw_hex":"' || lower(hex(encode(text))) || '","raw_base64":"' || to_base64(encode(text)) || '"}') AS document_md5 FROM documents""",
    "a12_decode_messages": with_ctes(f"""SELECT payload_encoding, count(*) AS rows, sum(length(d))::BIGINT AS chars FROM (
        SELECT 'json' AS payload_encoding, payload AS d FROM message UNION ALL SELECT 'xml', {XML} FROM lineitem UNION ALL SELECT 'csv', {CSV} FROM orders
        UNION ALL SELECT 'modbus_registers', {REG} FROM lineitem UNION ALL SELECT 'cbor', NULL FROM customer) GROUP BY 1""", "message"),
    "b1_explode_fields": with_ctes("SELECT message_id, pos::BIGINT AS pos, key, num_value, str_value FROM field", "field"),
    "b2_array_fields": """SELECT l_orderkey || '-' || l_linenumber AS message_id, pos::BIGINT AS pos, key, value_type, value FROM (
        SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['b.items[0].qty', 'b.items[0].in.d', 'b.items._count', 'marks', 'zero', 'a']) AS key,
        unnest(['float', 'float', 'integer', 'array', 'array', 'string']) AS value_type,
        unnest([regexp_replace(l_quantity::VARCHAR, '\\.0$', ''), regexp_replace(l_discount::VARCHAR, '\\.0$', ''), '2', '[' || l_linenumber || ',2]', '[]', '"' || l_returnflag || '"']) AS value FROM lineitem)""".replace("\\\\", "\\"),
    "b3_drop_null_fields": """SELECT c_custkey AS message_id, key, mode FROM (SELECT *, unnest(['a', 'n', 's']) AS key FROM customer), (VALUES ('all'), ('drop')) t(mode)
        WHERE mode = 'all' OR key = 's' OR (key = 'a' AND c_acctbal >= 0)""",
    "b4_infer_types": with_ctes("SELECT message_id, key, value_type FROM field", "field"),
    "b5_infer_units": with_ctes("SELECT message_id, key, inferred_unit FROM field", "field"),
    "b6_infer_semantics": with_ctes("SELECT message_id, key, inferred_semantic FROM field", "field"),
    "b7_flag_timestamps": with_ctes("SELECT message_id, key, is_timestamp FROM field", "field"),
    "b8_flag_identifiers": with_ctes("SELECT message_id, key, is_identifier FROM field", "field"),
    "b9_schema_signature": with_ctes("SELECT message_id, schema_signature FROM sig", "sig"),
    "b10_schema_inventory": with_ctes(f"""SELECT l.schema_signature, f.n AS field_count, 0.9::DOUBLE AS confidence, 'manual' AS source, {TS.format('l.created_at')} AS created_at, coalesce(c.hits, 0) AS hits
        FROM live l JOIN (SELECT schema_signature, created_at, count(*) AS n FROM dayfields GROUP BY ALL) f ON f.schema_signature = l.schema_signature AND f.created_at = l.created_at
        LEFT JOIN (SELECT schema_signature, count(*) AS hits FROM sig GROUP BY 1) c ON c.schema_signature = l.schema_signature""", "live", "dayfields"),
    "b11_registry_lookup": with_ctes(f"""SELECT s.schema_signature, d.schema_signature IS NOT NULL AS hit, {TS.format('d.created_at')} AS created_at FROM (SELECT DISTINCT schema_signature FROM sig) s
        LEFT JOIN (SELECT * FROM day WHERE {AS_OF} - created_at < INTERVAL 15 DAY QUALIFY row_number() OVER (PARTITION BY schema_signature ORDER BY created_at DESC) = 1) d USING (schema_signature)""", "day"),
    "b12_registry_upsert": with_ctes(f"""SELECT schema_signature, {TS.format('created_at')} AS created_at, hit_count, count(*) AS fields FROM dayfields
        WHERE (schema_signature, created_at) IN (SELECT (schema_signature, max(created_at)) FROM day GROUP BY schema_signature) GROUP BY ALL""", "dayfields"),
    "b13_registry_hits": with_ctes("SELECT schema_signature, count(*) AS hits FROM sig WHERE schema_signature IN (SELECT schema_signature FROM live) GROUP BY 1", "live"),
    "b14_field_summary": with_ctes("""SELECT message_id, 'Schema (' || schema_signature || '):' || chr(10) || string_agg('  - ' || key || ': ' || value_type || coalesce(' (' || inferred_unit || ')', '') || coalesce(' -> ' || inferred_semantic, ''), chr(10) ORDER BY pos) AS summary
        FROM field JOIN sig USING (message_id) GROUP BY message_id, schema_signature""", "sig"),
    "b15_extraction_stats": with_ctes("""SELECT (SELECT count(*) FROM sig) AS messages, (SELECT count(DISTINCT schema_signature) FROM sig) AS schemas, count(*) AS fields_extracted, count(inferred_unit) AS fields_with_unit, count(inferred_semantic) AS fields_with_hint FROM field""", "sig"),
    "c1_load_concepts": with_ctes("""SELECT concept_id, unit, datatype, n_aliases::BIGINT AS aliases, coalesce(n, 0) AS mapped_fields FROM concept LEFT JOIN (SELECT target_concept, count(*) AS n FROM mapping GROUP BY 1) ON target_concept = concept_id""", "concept", "mapping"),
    "c2_passthrough_mappings": with_ctes("SELECT schema_signature, key AS source_field, target_concept, target_field, confidence FROM mapping WHERE resolution_method = 'passthrough'", "mapping"),
    "c3_vectorize_names": with_ctes("SELECT key, bucket, round(weight, 6) AS weight FROM qvec", "qvec"),
    "c4_match_by_similarity": with_ctes(f"SELECT key, concept_id, round(similarity, 6) AS similarity, similarity >= {catalog.SIMILARITY_THRESHOLD} AS accepted FROM best", "best"),
    "c5_knn_join": f"""WITH v AS ({VECTORS}) SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, c.e), 9) DESC, c.vec_id) AS rank FROM v q, v c
        WHERE round(list_cosine_similarity(q.e, c.e), 9) >= 0.5 QUALIFY rank <= 5""",
    "c6_match_by_rules": with_ctes("SELECT key, concept_id, unit FROM ruled", "ruled"),
    "c6_match_by_rules_token": with_ctes(f"""SELECT key, concept_id, unit FROM (
        SELECT key, concept_id, unit, aord, CASE WHEN list_has_all({TOKENS.format('inferred_semantic')}, string_split(alias, '_')) THEN 0 ELSE 1 END AS stage FROM nm
        JOIN alias ON list_has_all({TOKENS.format('inferred_semantic')}, string_split(alias, '_')) OR list_has_all({TOKENS.format("replace(key, '.', '_')")}, string_split(alias, '_')))
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, aord) = 1""", "nm", "alias"),
    "c6_concept_table": with_ctes("""SELECT key, concept_id, unit FROM (
        SELECT key, concept_id, unit, ordinal, place, CASE WHEN contains(hint, alias) OR contains(alias, hint) THEN 0 ELSE 1 END AS stage FROM cname JOIN palias
        ON contains(hint, alias) OR contains(alias, hint) OR contains(low, alias)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, ordinal, place) = 1""", "cname", "palias"),
    "c6_concept_table_token": with_ctes(f"""SELECT key, concept_id, unit FROM (
        SELECT key, concept_id, unit, ordinal, place, CASE WHEN list_has_all(ht, t) THEN 0 ELSE 1 END AS stage
        FROM (SELECT key, {TOKENS.format('hint')} AS ht, {TOKENS.format('low')} AS kt FROM cname) JOIN (SELECT *, string_split(alias, '_') AS t FROM palias)
        ON list_has_all(ht, t) OR list_has_all(kt, t)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, ordinal, place) = 1""", "cname", "palias"),
    "c7_concept_table": with_ctes("""WITH asked AS (SELECT schema_signature, ordinal, min(pos) AS rank FROM cname JOIN palias ON contains(hint, alias) GROUP BY ALL),
        ranked AS (SELECT s.schema_signature, c.ordinal, coalesce(rank, 1073741824) AS rank FROM (SELECT DISTINCT schema_signature FROM cname) s
          CROSS JOIN (SELECT DISTINCT ordinal FROM palias) c LEFT JOIN asked a ON a.schema_signature = s.schema_signature AND a.ordinal = c.ordinal
          WHERE rank IS NOT NULL OR c.ordinal < 20 QUALIFY row_number() OVER (PARTITION BY s.schema_signature ORDER BY coalesce(rank, 1073741824), c.ordinal) <= 50)
        SELECT schema_signature, string_agg('part_' || ordinal, ',' ORDER BY rank, ordinal) AS concept_ids,
          md5(string_agg('- part_' || ordinal || ': ' || p_name || ' (unit: ' || lower(p_brand) || ', type: float, aliases: m' || ordinal || ', size_' || p_size || '_' || ordinal || ', ' || replace(p_name, ' ', '_') || ')', chr(10) ORDER BY rank, ordinal)) AS text_md5
        FROM ranked JOIN part ON p_partkey = ordinal GROUP BY schema_signature""", "cname", "palias").replace(") WITH asked AS", "), asked AS"),
    "c7_relevant_concepts": with_ctes("""SELECT schema_signature, string_agg(concept_id, ',' ORDER BY rank, ordinal) AS concept_ids, md5(string_agg(line, chr(10) ORDER BY rank, ordinal)) AS text_md5 FROM (
        SELECT s.schema_signature, c.ordinal, c.concept_id, '- ' || c.concept_id || ': ' || description || ' (unit: ' || unit || ', type: ' || datatype || ', aliases: ' || array_to_string(string_split(aliases, ' ')[1:3], ', ') || ')' AS line,
        coalesce((SELECT min(f.pos) FROM (SELECT schema_signature, key, min(pos) AS pos, any_value(inferred_semantic) AS h FROM field JOIN sig USING (message_id) GROUP BY 1, 2) f
          WHERE f.schema_signature = s.schema_signature AND list_bool_or(list_transform(string_split(c.aliases, ' '), lambda a: contains(f.h, a)))), 1000000) AS rank
        FROM (SELECT DISTINCT schema_signature FROM sig) s, concept c) GROUP BY 1""", "sig", "concept"),
    "c8_prompt_contents": with_ctes(f"""SELECT e.schema_signature, e.message_id, e.n AS open_fields, e.fields, c.concepts,
          'Protocol: ' || m.protocol || chr(10) || 'Topic: ' || m.topic || chr(10) || 'Device: ' || m.device_id AS head
        FROM (SELECT schema_signature, message_id, count(*) AS n, string_agg(key, ',' ORDER BY pos) AS fields FROM open GROUP BY ALL) e JOIN message m USING (message_id)
        JOIN (SELECT schema_signature, string_agg(concept_id, ',' ORDER BY rank, ordinal) AS concepts FROM (
          SELECT s.schema_signature, c.ordinal, c.concept_id, coalesce((SELECT min(f.pos) FROM open f WHERE f.schema_signature = s.schema_signature
            AND list_bool_or(list_transform(string_split(c.aliases, ' '), lambda a: contains(f.h, a)))), 1000000) AS rank
          FROM (SELECT DISTINCT schema_signature FROM open) s, concept c) GROUP BY 1) c USING (schema_signature)""", "open", "message", "concept"),
    "c9_load_llm_replies": with_ctes(f"""SELECT {EVENT_SIG} AS schema_signature, event_type AS source_field, concept AS target_concept, 't' || user_id AS target_field,
        round(least(1.0, value / 200), 6) AS confidence, event_type || ' device' AS device_context FROM reply WHERE concept IS NOT NULL
        UNION ALL SELECT {EVENT_SIG}, 'plain', 'power_watt', 'p', 0.8, event_type || ' device' FROM reply WHERE event_type <> 'error'""", "reply"),
    "c9_concept_table": """SELECT 'sig-' || event_id AS schema_signature, event_type AS source_field, 'part_' || user_id AS target_concept, 0::BIGINT AS ordinal
        FROM events JOIN part ON p_partkey = user_id WHERE p_partkey % 3 <> 0
        UNION ALL SELECT 'sig-' || event_id, 'b', 'part_' || (user_id + 1000000), 1 FROM events JOIN part ON p_partkey = user_id + 1000000 WHERE p_partkey % 3 <> 0
        UNION ALL SELECT 'sig-' || event_id, 'c', 'power_watt', 2 FROM events""",
    "c10_cap_per_window": f"""SELECT event_id, {TS.format("date_trunc('hour', ts)")} AS window_start, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) <= 3 AS within_budget FROM events""",
    "c11_validate_mappings": """SELECT event_id::VARCHAR AS schema_signature, event_type AS source_field, CASE WHEN bad THEN '_unmapped' ELSE 'power_watt' END AS target_concept,
        CASE WHEN bad THEN '_unmapped.' || event_type ELSE 't' || user_id END AS target_field, round(CASE WHEN bad THEN 0.0 ELSE value / 400 END, 6) AS confidence, CASE WHEN bad THEN 'passthrough' ELSE 'llm' END AS resolution_method
        FROM (SELECT *, event_type = 'signup' OR value / 400 > 1 AS bad FROM events)""",
    "c12_mapping_confidence": """SELECT 'user-' || user_id AS schema_signature, round(coalesce(least(1.0, sum(c * w) / sum(w)), 1.0), 6) AS confidence, count(*) AS mappings FROM (
        SELECT user_id, least(1.0, value / 400) AS c, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.9 WHEN 'purchase' THEN 1.1 END::DOUBLE AS w FROM events) GROUP BY 1""",
    "c13_learn_concepts": with_ctes("""SELECT concept_id, description, coalesce(rejected, 0) AS rejected FROM (SELECT concept_id, description FROM concept UNION ALL
        SELECT 'new_' || event_type, 'd' || min_by(user_id, 'sig-' || event_id) FROM reply WHERE event_type <> 'error' GROUP BY event_type) LEFT JOIN (
        SELECT id AS concept_id, CASE WHEN id = 'speed_mps' THEN count(*) ELSE count(*) - 1 END AS rejected FROM (SELECT 'new_' || event_type AS id FROM reply WHERE event_type <> 'error' UNION ALL SELECT 'speed_mps' FROM reply WHERE event_type <> 'error') GROUP BY 1) USING (concept_id)""", "reply", "concept"),
    "c14_apply_cached_mapping": with_ctes("""SELECT l.schema_signature, f.key, '_' || f.value_type AS target_concept, true AS hit FROM live l JOIN dayfields f ON f.schema_signature = l.schema_signature AND f.created_at = l.created_at
        UNION ALL SELECT schema_signature, key, NULL, false FROM sfield WHERE schema_signature NOT IN (SELECT schema_signature FROM live)""", "live", "dayfields", "sfield"),
    "c15_translate": with_ctes("""SELECT m.schema_signature, key AS source_field, target_concept, target_field, source_unit, target_unit, round(m.confidence, 6) AS confidence, resolution_method,
        round(o.confidence, 6) AS overall, llm_generated, device_context FROM mapping m JOIN overall o USING (schema_signature)""", "mapping", "overall"),
    "d1_apply_mappings": with_ctes("SELECT message_id, key, target_field, resolution_method FROM mapped", "mapped"),
    "d2_unmapped_fields": with_ctes("""SELECT 'evt-' || event_id AS message_id, '_unmapped.k' AS out_key, k::DOUBLE AS num_value FROM ev
        UNION ALL SELECT 'evt-' || event_id, '_unmapped.x' || event_type, 1.0 FROM ev WHERE NOT EXISTS (SELECT 1 FROM alias WHERE contains('x' || event_type, alias))""", "ev", "alias"),
    "d3_apply_null_strategy": """SELECT c_custkey::VARCHAR AS message_id, strategy, out_key, CASE WHEN out_key = 'co2_ppm' THEN NULL
        WHEN c_acctbal < 0 THEN CASE strategy WHEN 'default' THEN '0.0' END ELSE c_acctbal::VARCHAR END AS value
        FROM customer, (VALUES ('preserve'), ('omit'), ('default')) t(strategy), (VALUES ('temperature_celsius'), ('co2_ppm')) u(key0),
        LATERAL (SELECT CASE WHEN key0 = 'temperature_celsius' AND c_acctbal > 1000 THEN '_invalid.temperature_celsius' ELSE key0 END AS out_key)
        WHERE NOT (strategy = 'omit' AND (key0 = 'co2_ppm' OR c_acctbal < 0))""",
    "d4_unit_conversions": with_ctes("""SELECT from_unit, to_unit, count(*) AS rows, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (
        SELECT from_unit, to_unit, round((l_quantity + pre) * mul / div + post, 6) AS v FROM measure JOIN conv USING (from_unit)) GROUP BY 1, 2""", "measure", "conv"),
    "d5_conversion_paths": with_ctes("""SELECT from_unit, to_unit, max(hops)::BIGINT AS hops, count(*) AS rows, round(max(v), 6) AS high FROM (
        SELECT m.from_unit, to_unit, hops, round(((l_quantity + p1) * m1 / d1 + o1 + p2) * m2 / d2 + o2, 6) AS v FROM measure m JOIN (
          SELECT from_unit, to_unit, 1 AS hops, pre AS p1, mul AS m1, div AS d1, post AS o1, 0.0 AS p2, 1.0 AS m2, 1.0 AS d2, 0.0 AS o2 FROM conv
          UNION ALL (SELECT a.from_unit, b.to_unit, 2, a.pre, a.mul, a.div, a.post, b.pre, b.mul, b.div, b.post FROM conv a JOIN conv b ON b.from_unit = a.to_unit
            WHERE a.from_unit <> b.to_unit AND NOT EXISTS (SELECT 1 FROM conv c WHERE c.from_unit = a.from_unit AND c.to_unit = b.to_unit)
            QUALIFY row_number() OVER (PARTITION BY a.from_unit, b.to_unit ORDER BY a.ordinal) = 1)) p USING (from_unit)) GROUP BY 1, 2""", "measure", "conv"),
    "d6_convert_units": with_ctes("SELECT message_id, key, round(converted, 6) AS converted FROM mapped", "mapped"),
    "d7_apply_formulas": with_ctes(f"""SELECT message_id, key, formula, round(v, 6) AS converted, v IS NULL AS conversion_failed FROM (SELECT message_id, key, CASE key {' '.join(f"WHEN '{k}' THEN {text(f)}" for k, f in Q.FORMULAS)} END AS formula,
        CASE key {' '.join(f"WHEN '{k}' THEN {FORMULA_SQL[f]}" for k, f in Q.FORMULAS)} END AS v FROM mapped) WHERE formula IS NOT NULL""", "mapped"),
    "d7_formula_table": with_ctes("""SELECT message_id, key, format('{:.6f}', v)::DOUBLE AS converted, v IS NULL AS conversion_failed FROM (
        SELECT message_id, key, CASE WHEN d <> 0 THEN -(num_value - user_id) * 9.80665::DOUBLE / 7.3::DOUBLE / d + event_id % 4999 END AS v FROM (
          SELECT f.message_id, key, num_value, user_id, event_id, k::DOUBLE - 3 AS d FROM field f JOIN ev ON f.message_id = 'evt-' || event_id WHERE key IN ('temp_c', 'voltage', 'speed_kmh')))""", "field", "ev"),
    "d8_enforce_types": with_ctes("SELECT message_id, key, round(typed_number, 6) AS typed_number, type_failed FROM checked", "checked"),
    "d9_check_ranges": with_ctes("SELECT message_id, key, out_of_range FROM checked", "checked"),
    "d10_route_invalid": with_ctes("SELECT message_id, key, status, out_key FROM normal", "normal"),
    "d11_violations": with_ctes("""SELECT message_id, key AS field, status AS error, CASE WHEN status = 'type_mismatch' THEN datatype END AS expected, CASE WHEN status = 'type_mismatch' THEN 'str' END AS actual,
        CASE WHEN status = 'out_of_range' THEN round(typed_number, 6) END AS value, CASE WHEN status = 'out_of_range' THEN min_value END AS min, CASE WHEN status = 'out_of_range' THEN max_value END AS max,
        CASE WHEN status = 'type_mismatch' THEN 'Cannot convert str to ' || datatype || ': ' || to_json(str_value)::VARCHAR END AS details
        FROM normal WHERE status IN ('type_mismatch', 'out_of_range')""", "normal"),
    "d12_conversion_audit": with_ctes("SELECT message_id, key AS field, source_unit AS from_unit, target_unit AS to_unit, num_value AS original_value, round(converted, 6) AS converted_value FROM mapped WHERE converted IS NOT NULL", "mapped"),
    "d13_apply_precision": """SELECT l_orderkey, l_linenumber, target, round(sqrt(l_extendedprice), d) AS value FROM lineitem, (VALUES ('temperature_celsius', 2), ('humidity_percentage', 1), ('pressure_pascal', 6)) t(target, d)""",
    "d14_event_time": with_ctes(f"SELECT message_id, {TS.format('event_time')} AS event_time, fallback FROM done", "done"),
    "d15_enrich_metadata": with_ctes("""SELECT message_id, name, value FROM (SELECT d.message_id, unnest(['source_protocol', 'source_topic', 'translation_confidence', 'schema_signature', 'device_type', 'device_name', 'location', 'tags', 'inferred_context', 'llm_assisted']) AS name,
        unnest(['"' || protocol || '"', '"' || topic || '"', printf('%.6f', confidence), '"' || schema_signature || '"', CASE WHEN v.device_id IS NOT NULL THEN '"' || v.type || '"' END, CASE WHEN v.device_id IS NOT NULL THEN '"' || v.name || '"' END,
          CASE WHEN v.device_id IS NOT NULL THEN '"' || v.location || '"' END, CASE WHEN v.device_id IS NOT NULL THEN '["customer","' || v.segment || '"]' END, '"' || context || '"', CASE WHEN llm_generated THEN 'true' END]) AS value
        FROM done d LEFT JOIN device v USING (device_id)) WHERE value IS NOT NULL""", "done", "device"),
    "d16_device_upsert": with_ctes(f"""SELECT device_id, CASE WHEN ut IS NOT NULL THEN ut ELSE rt END AS type, CASE WHEN un IS NOT NULL THEN un ELSE rn END AS name, CASE WHEN ul IS NOT NULL THEN ul ELSE rl END AS location,
        rtags AS tags, {TS.format("coalesce(ua, ra)")} AS updated_at FROM (
        SELECT r.*, max_by('type-' || event_id, moved) FILTER (WHERE event_type = 'click' AND moved > since) AS ut, max_by('name-' || event_id, moved) FILTER (WHERE event_type = 'view' AND moved > since) AS un,
        max_by('place-' || event_id, moved) FILTER (WHERE event_type = 'error' AND moved > since) AS ul, max(moved) FILTER (WHERE moved > since AND event_type <> 'signup') AS ua FROM (
          SELECT device_id, CASE WHEN e.n IS NOT NULL THEN 'type-' || e.id ELSE d.type END AS rt, CASE WHEN e.n IS NOT NULL THEN 'name-' || e.id ELSE d.name END AS rn,
          CASE WHEN e.n IS NULL THEN d.location END AS rl, CASE WHEN e.n IS NULL THEN d.tags END AS rtags, coalesce(e.moved, d.updated_at) AS ra, coalesce(e.moved, TIMESTAMP '0001-01-01') AS since
          FROM device d FULL JOIN (SELECT 'user-' || user_id AS device_id, max_by(event_id, moved) AS id, max(moved) AS moved, count(*) AS n FROM (SELECT *, ts + INTERVAL 30 DAY + to_microseconds(event_id) AS moved FROM events) WHERE event_type = 'signup' GROUP BY 1) e USING (device_id)) r
        LEFT JOIN (SELECT *, 'user-' || user_id AS dev, ts + INTERVAL 30 DAY + to_microseconds(event_id) AS moved FROM events) x ON x.dev = r.device_id GROUP BY ALL)""", "device"),
    "d17_assemble_messages": with_ctes(f"""SELECT k.message_id, c.conversions, c.validation_errors, k.out_key AS name, {SIX.format("(CASE WHEN status = 'ok' THEN metric_value ELSE typed_number END)")} AS number, CASE WHEN jtype = 'VARCHAR' THEN str_value END AS text
        FROM kept k JOIN (SELECT message_id, count(converted) AS conversions, count(*) FILTER (WHERE status IN ('type_mismatch', 'out_of_range')) AS validation_errors FROM normal GROUP BY 1) c USING (message_id)""", "kept"),
    "d18_normalize": with_ctes(f"SELECT n.message_id, round(d.confidence, 6) AS confidence, pos::BIGINT AS pos, key, status, out_key, {SIX.format('metric_value')} AS metric_value FROM normal n JOIN done d USING (message_id)", "normal", "done"),
    "e1_route_kafka": with_ctes("""SELECT message_id, CASE WHEN contains(device_id, 'user-1') THEN 'devices.first' WHEN device_id LIKE '%5' THEN 'iot.normalized.cold_room' WHEN device_id LIKE '%7' THEN 'iot.normalized.general'
        WHEN context = 'unknown' THEN 'context.unknown' ELSE 'iot.normalized.' || coalesce(context, 'general') END AS kafka_topic FROM done""", "done"),
    "e2_route_mqtt": with_ctes("SELECT message_id, CASE WHEN contains(device_id, 'user-12') THEN 'special/twelve' ELSE 'normalized/' || device_id END AS mqtt_topic FROM message", "message"),
    "e1_e2_rule_table": """WITH p AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL),
        r AS (SELECT o, event_type = 'error' AS context, CASE WHEN event_type = 'error' THEN 'error-' || user_id % 40 WHEN user_id % 4 = 0 THEN 'r-' || user_id WHEN user_id % 4 = 1 THEN 'user-' || user_id
          WHEN user_id % 4 = 2 THEN user_id::VARCHAR ELSE 'no-' || user_id END AS pattern, CASE WHEN o % 3 > 0 THEN 'k.' || o END AS k, CASE WHEN o % 2 > 0 THEN 'm/' || o END AS m FROM p),
        one AS (SELECT context, pattern, min(o) AS o, (max(struct_pack(o, k))).k AS k, (max(struct_pack(o, m))).m AS m FROM r GROUP BY ALL),
        e AS (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN 'user-' || (user_id + event_id % 3 * 700) END AS device, CASE WHEN event_id % 7 > 0 THEN event_type || '-' || user_id % 50 END AS context FROM events),
        d AS (SELECT DISTINCT device FROM e WHERE device IS NOT NULL),
        dk AS (SELECT device, arg_min(k, o) AS k FROM d JOIN one ON NOT context AND k IS NOT NULL AND contains(device, pattern) GROUP BY device),
        dm AS (SELECT device, arg_min(m, o) AS m FROM d JOIN one ON NOT context AND m IS NOT NULL AND contains(device, pattern) GROUP BY device)
        SELECT 'evt-' || event_id AS message_id, coalesce(dk.k, c.k, 'iot.normalized.' || coalesce(lower(replace(e.context, ' ', '_')), 'general')) AS kafka_topic, coalesce(dm.m, 'normalized/' || e.device) AS mqtt_topic
        FROM e LEFT JOIN dk USING (device) LEFT JOIN dm USING (device) LEFT JOIN one c ON c.context AND c.pattern = e.context""",
    "e3_fan_out": with_ctes("""SELECT message_id, output, CASE WHEN output = 'kafka' AND contains(target0, 'user-1') THEN 'devices.first' WHEN output = 'mqtt' AND contains(target, 'user-12') THEN 'special/twelve' ELSE target END AS target
        FROM (SELECT f.*, m.device_id AS target0 FROM fan f JOIN message m USING (message_id))""", "fan"),
    "e4_format_json": with_ctes("SELECT message_id, message_id AS id_in_json, schema_signature AS signature, context, strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS event_time, topic FROM done", "done"),
    "e5_format_jsonld": with_ctes("SELECT message_id, 'urn:fieldloom:message:' || message_id AS id, 'sosa:Observation' AS type, device_id AS feature, context AS description, strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS result_time, protocol AS first_property FROM done", "done"),
    "e4_format_json_whole": with_ctes(f"""SELECT message_id, 'data' AS part, name, {SIX.format("number")} AS number, CASE WHEN number IS NULL THEN text END AS text FROM shown
        UNION ALL SELECT message_id, 'conversion', key, round(converted, 6), source_unit || '>' || target_unit FROM mapped WHERE converted IS NOT NULL
        UNION ALL SELECT message_id, 'metadata', name, number, text FROM property""", "shown", "mapped", "property"),
    "e5_format_jsonld_whole": with_ctes(f"""SELECT message_id, 'result' AS part, name, {SIX.format("number")} AS number, CASE WHEN number IS NULL THEN text END AS text FROM shown
        UNION ALL SELECT DISTINCT message_id, 'result', '@type', NULL, 'sosa:Result' FROM done
        UNION ALL SELECT message_id, 'property', name, number, text FROM property""", "shown", "property"),
    "e6_to_metrics": with_ctes(f"SELECT {TS.format('time')} AS time, device_id, metric, {SIX.format('value')} AS value, message_id FROM metric", "metric"),
    "e7_write_metrics": with_ctes(f"SELECT {TS.format('time')} AS time, strftime(time, '%Y-%m-%d') AS date, device_id, metric, {SIX.format('value')} AS value, message_id FROM metric", "metric"),
    "e9_delivery_report": with_ctes("""SELECT m.message_id, coalesce(bool_and(ok), true) AS success, coalesce(bool_or(ok), false) AS partial_success, count(output) AS outputs, coalesce(sum(CASE WHEN ok THEN 1 ELSE 3 END), 0)::BIGINT AS attempts
        FROM message m LEFT JOIN delivery d USING (message_id) GROUP BY 1""", "message", "delivery"),
    "e10_dry_run": with_ctes(f"""SELECT d.message_id, schema_signature, round(confidence, 6) AS confidence, llm_generated, context, {TS.format('event_time')} AS event_time, n AS fields, 'done' AS outcome
        FROM done d JOIN (SELECT message_id, count(*) AS n FROM kept GROUP BY 1) USING (message_id)""", "done", "kept"),
    "f1_hourly_rollup": with_ctes(f"SELECT {ROLLUP_OUT} FROM (SELECT date_trunc('hour', time) AS bucket, device_id, metric, {ROLLUP} FROM metric GROUP BY 1, 2, 3)", "metric"),
    "f2_refresh_rollup": with_ctes(f"""SELECT {ROLLUP_OUT} FROM (SELECT date_trunc('hour', time) AS bucket, device_id, metric, {ROLLUP} FROM (
        SELECT time, device_id, metric, CASE WHEN time >= TIMESTAMP '2024-01-20 10:00:00' AND time < TIMESTAMP '2024-01-20 11:00:00' THEN value * 2 ELSE value END AS value FROM received) GROUP BY 1, 2, 3)""", "received"),
    "f3_apply_retention": with_ctes(f"SELECT message_id, {TS.format('time')} AS time FROM received WHERE time >= {AS_OF} - INTERVAL 7 DAY", "received"),
    "f4_series_slice": with_ctes(f"""SELECT slice, message_id, {TS.format('time')} AS time, value FROM (SELECT 'device' AS slice, * FROM received WHERE device_id = 'user-1' AND metric = 'click' AND time >= TIMESTAMP '2024-01-05' AND time < {AS_OF}
        UNION ALL (SELECT 'newest', * FROM received WHERE metric = 'view' ORDER BY time DESC, device_id, metric, message_id LIMIT 100))""", "received"),
    "s1_run_stream": with_ctes(f"SELECT {TS.format('time')} AS time, device_id, metric, {SIX.format('value')} AS value, message_id FROM metric", "metric"),
    "s2_stream_rollup": with_ctes(f"""SELECT {ROLLUP_OUT} FROM (SELECT date_trunc('hour', time) AS bucket, device_id, metric, {ROLLUP} FROM received GROUP BY 1, 2, 3)""", "received"),
    "s4_trigger_policy": with_ctes(f"SELECT {ROLLUP_OUT} FROM (SELECT date_trunc('hour', time) AS bucket, device_id, metric, {ROLLUP} FROM received GROUP BY 1, 2, 3)", "received"),
    "s3_stream_registry": with_ctes(f"""SELECT schema_signature, count(*) AS fields, round(any_value(o.confidence), 6) AS confidence, 'learned' AS source, {TS.format(AS_OF)} AS created_at
        FROM mapping JOIN overall o USING (schema_signature) GROUP BY 1""", "mapping", "overall"),
    "g1_clean_text": f"""SELECT id, md5(t) AS text_md5, length(t)::BIGINT AS chars FROM (SELECT id, regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(nfc_normalize(substr(text, 1, 10000)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
        '^{SPACES}+|{SPACES}+$', '', 'g') AS t FROM ({DOCS} UNION ALL {TURNS}))""",
    "g2_clean_identifiers": r"SELECT doc_id, nullif(ltrim(substr(regexp_replace(text, '[^a-zA-Z0-9._\-]', '', 'g'), 1, 255), '._-'), '') AS clean_id FROM documents",
    "g3_clean_topics": r"SELECT page_id, url AS topic, substr(trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9/+#._\-]', '', 'g'), '/+', '/', 'g'), '/'), 1, 1000) AS clean_topic FROM pages",
    "g4_topic_validity": with_ctes(f"SELECT id, {TOPIC_OK} AS valid_topic FROM (SELECT 'page-' || page_id AS id, url AS topic FROM pages UNION ALL SELECT message_id, topic FROM message UNION ALL SELECT 'doc-' || doc_id, source || '/' || lang || '/..' FROM documents)", "message"),
    "g5_depth_gate": with_ctes("SELECT id, (2 * n)::BIGINT AS depth, 2 * n <= 8 AS depth_ok FROM nested", "nested"),
    "g6_size_gate": with_ctes("SELECT id, (n + 2)::BIGINT AS key_count, 6::BIGINT AS longest_string, n + 2 <= 5 AS size_ok FROM nested", "nested"),
    "g7_clean_keys": with_ctes("SELECT message_id, '_ü ' || key AS key, key AS clean_key FROM field", "field"),
    "g8_numeric_gate": f"""SELECT id, CASE WHEN reason IS NULL THEN round(x, 6) END AS number, reason, coalesce(reason IS NULL AND x = floor(x), false) AS is_whole FROM (
        SELECT *, CASE WHEN x IS NULL THEN 'not a number' WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN 'infinity' WHEN x < 1 THEN 'below minimum' WHEN x > 400 THEN 'above maximum' END AS reason FROM (SELECT id, {NUM} AS x FROM (
        SELECT 'evt-' || event_id AS id, CASE event_type WHEN 'click' THEN value::VARCHAR WHEN 'view' THEN ' ' || user_id || ' ' WHEN 'purchase' THEN 'nan' WHEN 'signup' THEN '-inf' ELSE '1_' || user_id || 'x' END AS raw FROM events
        UNION ALL SELECT 'turn-' || conv_id || '-' || turn, turn::VARCHAR FROM conversations)))""",
    "g9_payload_size_gate": "SELECT doc_id, octet_length(encode(text))::BIGINT AS payload_bytes, octet_length(encode(text)) <= 4096 AS size_ok FROM documents",
    "g10_threat_scan": f"SELECT id, {THREATS} AS threat FROM ({DOCS} UNION ALL {PAGES} UNION ALL {TURNS})",
    "g11_membership_gate": with_ctes("""SELECT message_id, key, value_type <> 'numeric_string' AS type_ok, device_id NOT LIKE '%3' AS protocol_ok, coalesce(num_value / 100 BETWEEN 0 AND 1, false) AS confidence_ok FROM field""", "field"),
    "g12_payload_verdict": with_ctes("""SELECT id, message IS NULL AS valid, message FROM (SELECT id, CASE WHEN octet_length(encode(payload)) > 8000 THEN 'Payload size (' || octet_length(encode(payload)) || ') exceeds maximum (8000)'
        WHEN NOT json_valid(payload) THEN 'Invalid JSON' WHEN 2 * n > 8 THEN 'JSON depth exceeded: maximum is 8' END AS message FROM (SELECT id, n, payload FROM nested UNION ALL SELECT 'doc-' || doc_id, 0, text FROM documents))""", "nested"),
    "h1_message_counts": with_ctes("SELECT protocol, device_type, error_type, count(*) AS received, count(*) FILTER (WHERE NOT failed) AS processed, count(*) FILTER (WHERE failed) AS failed FROM outcome GROUP BY ALL", "outcome"),
    "h2_latency_histogram": f"""SELECT event_type, le, count(*) FILTER (WHERE value / 100 <= b) AS count, round(sum(value / 100), 4) AS total FROM events, (VALUES {', '.join(f"('{b}', {b}::DOUBLE)" for b in catalog.LATENCY_BOUNDS)}, ('+Inf', 'inf'::DOUBLE)) t(le, b) GROUP BY 1, 2""",
    "h3_cache_hit_ratio": with_ctes("""SELECT hits, misses, round(hits / (hits + misses), 6) AS ratio FROM (SELECT count(*) FILTER (WHERE l.schema_signature IS NOT NULL) AS hits, count(*) FILTER (WHERE l.schema_signature IS NULL) AS misses FROM sig LEFT JOIN live l USING (schema_signature))""", "live", "sig"),
    "h4_unique_devices": with_ctes("SELECT protocol, count(DISTINCT device_id) AS devices FROM message GROUP BY 1", "message"),
    "h5_device_message_rate": with_ctes(f"SELECT device_id, {TS.format('m')} AS minute, n AS messages FROM (SELECT device_id, date_trunc('minute', ts) AS m, count(*) AS n FROM message GROUP BY 1, 2)", "message"),
    "h6_output_volume": with_ctes("SELECT output, CASE WHEN ok THEN 'success' ELSE 'failure' END AS status, count(*) AS messages, sum(octet_length(encode(payload)))::BIGINT AS bytes FROM delivery GROUP BY 1, 2", "delivery"),
    "h7_llm_usage": "SELECT 'model-' || event_type AS model, CASE WHEN value > 400 THEN 'error' ELSE 'ok' END AS status, count(*) AS requests, sum(length(props))::BIGINT AS tokens FROM events GROUP BY 1, 2",
    "h8_health_snapshot": with_ctes("SELECT count(*) AS messages_received, count(*) FILTER (WHERE NOT failed) AS messages_processed, count(*) FILTER (WHERE failed) AS messages_failed, (SELECT count(*) FROM seeded) AS cache_schemas FROM outcome", "outcome", "seeded"),
}
