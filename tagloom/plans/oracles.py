"""ANSI SQL that states the expected result of each query in a different way.

The texts avoid the method of the Spark side: correlated lookups in place of
``lag``, survivors passed from one CTE to the next in place of one annotated
table, recursion in place of the closed form, and source columns in place of
decoded bytes.
"""

from __future__ import annotations

from .tables import CHUNKS_SQL, LINEITEM_READS_SQL, READS_SQL, REGISTRY_SQL, STATUS_SQL

READS = f"reads AS ({READS_SQL})"
REGISTRY = f"registry AS ({REGISTRY_SQL})"
STATUS = f"status AS ({STATUS_SQL})"
LOCAL = "(eval_ts + INTERVAL 330 MINUTE)"  # the zone of the queries is five and a half hours ahead
SHIFT_ID = f"strftime({LOCAL} - INTERVAL 6 HOUR, '%Y-%m-%d') || '_06:00'"
R2 = "round(CAST(rssi AS DOUBLE), 2)"
RSSI_1 = "CAST(round(CAST(CAST(rssi AS DOUBLE) AS DECIMAL(18, 8)), 1) AS DECIMAL(18, 1))"
TIME = f"CAST({LOCAL} AS TIME)"


def _filter(condition: str) -> str:
    return f"WITH {READS} SELECT seq, epc, antenna_port, {R2} AS rssi FROM reads WHERE {condition}"


def _number(column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


# -- sources

_DECODED = """
SELECT event_id AS seq,
       CASE event_id % 8 WHEN 3 THEN concat('{"epc":"E', user_id, '",}')
                         WHEN 6 THEN concat('{"epc":"E', user_id, '","rssi":"-5"}')
                         ELSE concat('E', user_id) END AS epc,
       CASE WHEN event_id % 8 = 0 THEN 'T1' END AS tid,
       CASE WHEN event_id % 8 = 0 THEN -61.5::DOUBLE ELSE -50.0::DOUBLE END AS rssi,
       CAST(CASE WHEN event_id % 8 = 0 THEN 2 ELSE 1 END AS INTEGER) AS antenna_port"""
_YIELDS = "FROM events WHERE event_id % 8 NOT IN (4, 5)"
_WHOLE_RSSI = "CAST(-floor(CAST(-rssi AS DOUBLE)) AS DOUBLE)"

DECODED_TEXT = f"{_DECODED} {_YIELDS}"
DECODED_MQTT = f"{_DECODED}, concat('gate/', event_id % 5) AS topic {_YIELDS}"
DECODED_FRAMES = f"""WITH {READS}
SELECT seq, reader_id, epc, {_WHOLE_RSSI} AS rssi, antenna_port, 'Identium Gate 1' AS location
FROM reads WHERE seq % 11 <> 0"""
DECODED_REPORTS = f"""WITH {READS}
SELECT CAST(floor(seq / 4) AS BIGINT) AS message_no, CAST(seq % 4 AS INTEGER) AS tag_no, epc, {_WHOLE_RSSI} AS rssi,
       antenna_port FROM reads"""
def _frames_of(messages: int, more: str = "") -> str:
    return f"""WITH {READS},
parts AS (SELECT seq, CAST(floor(seq / 4) AS BIGINT) AS m,
                 (CASE WHEN seq % 5 = 0 THEN '00F0001B00F100120060' ELSE '00F000168D' END) || epc || 'DA'
                 || lpad(hex(256 - CAST(floor(CAST(-rssi AS DOUBLE)) AS BIGINT)), 2, '0') || 'DD'
                 || lpad(hex(antenna_port), 4, '0') AS part FROM reads),
bodies AS (SELECT m, string_agg(part, '' ORDER BY seq) AS body FROM parts GROUP BY m)
SELECT concat('capture-', CAST(floor(m / {messages}) AS BIGINT)) AS path, m % {messages} AS frame_no,
       '043D' || lpad(hex(CAST(length(body) / 2 + 10 AS BIGINT)), 8, '0') || lpad(hex(m), 8, '0') || body AS message_hex{more}
FROM bodies"""


CAPTURE_FRAMES = _frames_of(16)
CAPTURE_FILES = _frames_of(1024, ", false AS truncated")
VENDOR = f"WITH {READS} SELECT seq, reader_id, epc, {R2} AS rssi, antenna_port, tid FROM reads"
LINES = f"""WITH chunks AS ({CHUNKS_SQL}),
texts AS (SELECT stream_id, string_split(string_agg(data, '' ORDER BY chunk_no), chr(10)) AS parts FROM chunks
          GROUP BY stream_id),
pieces AS (SELECT stream_id, len(parts) AS n, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM texts)
SELECT stream_id, line_no, trim(line) AS line FROM pieces WHERE line <> '' OR line_no < n - 1"""
ROUTED = f"""WITH {READS}
SELECT seq, reader_id,
       CASE seq % 6 WHEN 0 THEN 'tcp-socket' WHEN 1 THEN 'mqtt-broker' WHEN 2 THEN 'identium' WHEN 3 THEN 'llrp'
                    WHEN 4 THEN 'zebra' ELSE 'no-such' END AS provider_id,
       CASE WHEN seq % 6 < 5 THEN epc END AS epc,
       CASE WHEN seq % 6 < 2 THEN -50.0::DOUBLE WHEN seq % 6 < 4 THEN {_WHOLE_RSSI} WHEN seq % 6 = 4 THEN {R2} END AS rssi,
       CASE WHEN seq % 6 = 0 THEN 1 WHEN seq % 6 < 5 THEN antenna_port ELSE 0 END AS antenna_port,
       CASE WHEN seq % 6 = 1 THEN concat('gate/', seq % 5) END AS topic,
       CASE WHEN seq % 6 = 5 THEN 'quarantine' ELSE 'decoded' END AS outcome
FROM reads"""
NORMALIZED = f"""WITH {READS}
SELECT seq, epc, CAST(NULL AS VARCHAR) AS tid, CAST(NULL AS VARCHAR) AS user_memory,
       CASE WHEN seq % 2 = 0 THEN antenna_port ELSE 1 END AS antenna_port, 0.0::DOUBLE AS rssi,
       CAST(1 AS INTEGER) AS read_count, epoch_us(eval_ts) AS first_seen, epoch_us(eval_ts) AS last_seen, reader_id,
       CAST(NULL AS VARCHAR) AS location, CAST(0 AS INTEGER) AS metadata_size FROM reads"""

# -- stateless filters

METADATA = f"""WITH {READS}, coded AS (SELECT *, CASE
    WHEN rssi < CAST(-75 AS FLOAT) THEN 'rssi' WHEN antenna_port NOT IN (1, 2, 4) THEN 'antenna'
    WHEN length(epc) < 10 THEN 'min_length' WHEN length(epc) > 24 THEN 'max_length'
    WHEN lower(epc) NOT LIKE 'e280%' THEN 'prefix' WHEN epc NOT LIKE '%5' THEN 'suffix'
    WHEN NOT regexp_matches(epc, '0[0-7]5$') THEN 'regex' END AS drop_code FROM reads)
SELECT seq, CASE WHEN drop_code IS NOT NULL THEN 'MetadataFilter' END AS drop_stage, drop_code, CASE drop_code
    WHEN 'rssi' THEN concat('RSSI ', {RSSI_1}, ' dBm is below threshold -75.0 dBm.')
    WHEN 'antenna' THEN printf('Antenna port %d disabled by bitmask 0xB.', antenna_port)
    WHEN 'suffix' THEN concat('EPC ''', epc, ''' does not end with required suffix ''5''.')
    WHEN 'regex' THEN concat('EPC ''', epc, ''' does not match regex pattern ''0[0-7]5$''.') END AS drop_reason
FROM coded"""
SCHEDULE = f"""WITH {READS}, coded AS (SELECT *, dayname({LOCAL}) AS day, CASE
    WHEN dayofweek({LOCAL}) NOT IN (1, 3, 6) THEN 'day'
    WHEN hour({LOCAL}) BETWEEN 6 AND 21 AND {TIME} <> TIME '06:00:00' THEN 'hours' END AS drop_code FROM reads)
SELECT seq, drop_code, CASE drop_code WHEN 'day' THEN concat('Tag read on ', day, ' outside configured operating days.')
    WHEN 'hours' THEN concat('Time ', strftime({LOCAL}, '%H:%M:%S'),
                             ' is outside operating window (22:00:00 - 06:00:00).') END AS drop_reason FROM coded"""

# -- stateful dedup


def _survives(table: str, keys: list[str], window: str) -> str:
    """No earlier read of the key lies less than the window back."""
    same = " AND ".join(f"p.{k} = r.{k}" for k in keys)
    return f"""NOT EXISTS (SELECT 1 FROM {table} p WHERE {same} AND p.seq < r.seq
        AND p.eval_ts <= r.eval_ts AND p.eval_ts > r.eval_ts - {window})"""


SLIDING = f"""WITH {READS} SELECT seq, epc FROM reads r
WHERE {_survives('reads', ['epc'], "INTERVAL 6 HOUR")}"""
SLIDING_READER = f"""WITH {READS} SELECT seq, epc, reader_id FROM reads r
WHERE {_survives('reads', ['epc', 'reader_id'], "INTERVAL 12 HOUR")}"""
SLIDING_ANTENNA = f"""WITH {READS} SELECT seq, epc, reader_id, antenna_port FROM reads r
WHERE {_survives('reads', ['epc', 'reader_id', 'antenna_port'], "INTERVAL 48 HOUR")}"""
SHIFT_IDS = f"WITH {READS} SELECT seq, {SHIFT_ID} AS shift_id FROM reads"
DAILY = f"""WITH {READS}, s AS (SELECT *, {SHIFT_ID} AS shift_id FROM reads),
firsts AS (SELECT shift_id, epc, min(seq) AS seq FROM s GROUP BY shift_id, epc)
SELECT s.seq, s.epc, s.shift_id FROM s JOIN firsts f ON s.seq = f.seq"""
DECODED_DAILY = f"""WITH {READS},
m AS (SELECT seq AS old, epc, max(eval_ts) OVER (PARTITION BY CAST(floor(seq / 4) AS BIGINT)) AS eval_ts,
      row_number() OVER (ORDER BY seq) AS seq FROM reads),
s AS (SELECT *, {SHIFT_ID} AS shift_id FROM m),
firsts AS (SELECT min(seq) AS seq FROM s GROUP BY shift_id, epc)
SELECT s.seq, s.epc, s.shift_id FROM s WHERE seq IN (SELECT seq FROM firsts)"""
ROLLOVERS = f"""WITH {READS}, s AS (SELECT seq, {SHIFT_ID} AS shift_id FROM reads)
SELECT b.seq, a.shift_id AS previous_shift_id, b.shift_id FROM s a JOIN s b ON b.seq = a.seq + 1
WHERE a.shift_id <> b.shift_id"""
ACTIVE = f"""WITH {READS}
SELECT {SHIFT_ID} AS shift_id, count(DISTINCT epc) AS active_keys FROM reads GROUP BY 1"""
LIVE = f"""WITH {READS} SELECT count(DISTINCT epc) AS active_keys FROM reads
WHERE eval_ts <= TIMESTAMP '2024-01-20' AND eval_ts > TIMESTAMP '2024-01-19 18:00:00'"""
LINEITEM_SHIFTS = f"""WITH big AS ({LINEITEM_READS_SQL})
SELECT strftime(eval_ts, '%Y-%m-%d') || '_00:00' AS shift_id, count(DISTINCT (epc, reader_id)) AS active_keys
FROM big GROUP BY 1"""

# -- chain

CHAIN = f"""{READS}, chain_in AS (SELECT *, {SHIFT_ID} AS shift_id, {TIME} AS t FROM reads),
after_sliding AS (SELECT * FROM chain_in r WHERE {_survives('chain_in', ['epc'], "INTERVAL 6 HOUR")}),
after_daily AS (SELECT * FROM after_sliding WHERE seq IN (SELECT min(seq) FROM after_sliding GROUP BY shift_id, epc)),
after_metadata AS (SELECT * FROM after_daily WHERE rssi >= CAST(-75 AS FLOAT) AND antenna_port <= 3),
survivors AS (SELECT * FROM after_metadata WHERE t BETWEEN TIME '08:00:00' AND TIME '20:00:00'),
verdicts AS (SELECT c.*, CASE
    WHEN seq NOT IN (SELECT seq FROM after_sliding) THEN 'sliding'
    WHEN seq NOT IN (SELECT seq FROM after_daily) THEN 'daily'
    WHEN seq NOT IN (SELECT seq FROM after_metadata) THEN CASE WHEN rssi < CAST(-75 AS FLOAT) THEN 'rssi' ELSE 'antenna' END
    WHEN seq NOT IN (SELECT seq FROM survivors) THEN 'hours' END AS drop_code FROM chain_in c),
staged AS (SELECT *, CASE drop_code WHEN 'sliding' THEN 'SlidingWindowFilter' WHEN 'daily' THEN 'DailyUniqueFilter'
    WHEN 'rssi' THEN 'MetadataFilter' WHEN 'antenna' THEN 'MetadataFilter' WHEN 'hours' THEN 'ScheduleFilter' END
    AS drop_stage FROM verdicts)"""
DEFAULT_CHAIN = f"""WITH {CHAIN}, gaps AS (SELECT seq AS gap_seq, epoch_us(eval_ts)
    - epoch_us((SELECT arg_max(p.eval_ts, p.seq) FROM reads p WHERE p.epc = r.epc AND p.seq < r.seq)) AS gap_us FROM reads r)
SELECT seq, epc, drop_stage, drop_code, CASE drop_code
    WHEN 'sliding' THEN concat('Tag ''', epc, ''' deduplicated (last seen ',
        CAST(round(CAST(gap_us AS DECIMAL(18, 6)) / 1000000, 1) AS DECIMAL(18, 1)), 's ago, window: 21600s).')
    WHEN 'daily' THEN concat('Tag ''', epc, ''' already processed in shift ''', shift_id, '''.')
    WHEN 'rssi' THEN concat('RSSI ', {RSSI_1}, ' dBm is below threshold -75.0 dBm.')
    WHEN 'antenna' THEN printf('Antenna port %d disabled by bitmask 0x7.', antenna_port)
    WHEN 'hours' THEN concat('Time ', strftime({LOCAL}, '%H:%M:%S'), ' is outside operating window (08:00:00 - 20:00:00).')
    END AS drop_reason FROM staged JOIN gaps ON gap_seq = seq"""
COUNTERS = f"""WITH {CHAIN} SELECT (SELECT count(*) FROM reads) AS evaluated, (SELECT count(*) FROM survivors) AS passed,
    (SELECT count(*) FROM reads) - (SELECT count(*) FROM survivors) AS dropped"""
DROPS = f"""WITH {CHAIN} SELECT drop_stage, drop_code, count(*) AS reads FROM staged WHERE drop_code IS NOT NULL
GROUP BY drop_stage, drop_code"""
OTHER_CHAIN = f"""WITH {READS}, strong AS (SELECT *, {SHIFT_ID} AS shift_id FROM reads WHERE rssi >= CAST(-70 AS FLOAT)),
unique_reads AS (SELECT * FROM strong WHERE seq IN (SELECT min(seq) FROM strong GROUP BY shift_id, epc, reader_id)),
final AS (SELECT * FROM unique_reads r WHERE {_survives('unique_reads', ['epc', 'reader_id'], "INTERVAL 12 HOUR")}),
coded AS (SELECT seq, CASE WHEN seq NOT IN (SELECT seq FROM strong) THEN 1
    WHEN seq NOT IN (SELECT seq FROM unique_reads) THEN 2 WHEN seq NOT IN (SELECT seq FROM final) THEN 3 END AS c FROM reads)
SELECT seq, CASE c WHEN 1 THEN 'MetadataFilter' WHEN 2 THEN 'DailyUniqueFilter' WHEN 3 THEN 'SlidingWindowFilter' END
    AS drop_stage, CASE c WHEN 1 THEN 'rssi' WHEN 2 THEN 'daily' WHEN 3 THEN 'sliding' END AS drop_code FROM coded"""
CUSTOM = f"""WITH {READS}, kept AS (SELECT * FROM reads WHERE CAST(substr(reader_id, 8) AS INTEGER) % 2 = 0),
final AS (SELECT * FROM kept r WHERE {_survives('kept', ['epc'], "INTERVAL 6 HOUR")})
SELECT seq, CASE WHEN seq NOT IN (SELECT seq FROM kept) THEN 'EvenReaders'
    WHEN seq NOT IN (SELECT seq FROM final) THEN 'SlidingWindowFilter' END AS drop_stage,
    CASE WHEN seq NOT IN (SELECT seq FROM kept) THEN 'custom'
    WHEN seq NOT IN (SELECT seq FROM final) THEN 'sliding' END AS drop_code FROM reads"""

# -- lookups

ENRICHED = f"""WITH {READS}, {REGISTRY} SELECT seq, r.reader_id, coalesce(g.provider_id, 'System') AS provider_id,
    coalesce(g.brand_name, 'RFID Reader') AS brand_name FROM reads r LEFT JOIN registry g ON g.reader_id = r.reader_id"""
STATUS_PROVIDER = f"""WITH {STATUS}, {REGISTRY},
s AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN 'reader-x' ELSE reader_id END AS reader_id, new_state FROM status)
SELECT seq, s.reader_id, new_state,
    coalesce((SELECT provider_id FROM registry g WHERE g.reader_id = s.reader_id), 'Unknown') AS provider_id FROM s"""

# -- batches

INSTANT = "SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS batch_id, CAST(1 AS BIGINT) AS batch_pos FROM events"
POSITIONS = f"positions AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM reads)"
COUNTED = f"""batched AS (SELECT *, CAST(CAST(floor((i - 1) / 20) AS BIGINT) AS VARCHAR) AS batch_id,
    (i - 1) % 20 + 1 AS batch_pos FROM positions)"""
TICK = "greatest(1, CAST(ceil((epoch_us(eval_ts) - 1704067200000000) / 3600000000) AS BIGINT))"
COUNT = f"WITH {READS}, {POSITIONS}, {COUNTED} SELECT seq, batch_id, batch_pos FROM batched"
HYBRID = f"""WITH {READS}, n AS (SELECT seq, {TICK} AS tick, row_number() OVER (PARTITION BY {TICK} ORDER BY seq) AS i FROM reads)
SELECT seq, concat(tick, '-', CAST(floor((i - 1) / 20) AS BIGINT)) AS batch_id, (i - 1) % 20 + 1 AS batch_pos FROM n"""
PERIODIC = f"""WITH RECURSIVE {READS}, {POSITIONS},
arrivals AS (SELECT {TICK} AS tick, count(*) AS n FROM reads GROUP BY 1),
total AS (SELECT count(*) AS n, max(tick) AS last FROM (SELECT {TICK} AS tick FROM reads)),
upto AS MATERIALIZED (SELECT k, coalesce(sum(n), 0) AS a FROM (SELECT unnest(range(1, (SELECT last + n // 20 + 2 FROM total))) AS k)
         LEFT JOIN arrivals ON tick <= k GROUP BY k),
sent AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS s
         UNION ALL SELECT u.k, sent.s, CAST(least(u.a, sent.s + 20) AS BIGINT) FROM sent JOIN upto u ON u.k = sent.k + 1)
SELECT seq, CAST(k AS VARCHAR) AS batch_id, i - before AS batch_pos FROM positions JOIN sent ON i > before AND i <= s"""

# -- payloads

SCAN = "sha256(concat_ws(chr(31), epc, CAST(epoch_us(eval_ts) AS VARCHAR), CAST(antenna_port AS VARCHAR), reader_id))"
BATCHES = f"""{READS}, {REGISTRY}, {POSITIONS}, {COUNTED},
heads AS (SELECT batch_id, reader_id AS device_id, epc AS first_epc, rssi AS first_rssi FROM batched WHERE batch_pos = 1),
sums AS (SELECT batch_id, count(*) AS n, max(eval_ts) AS sent, min(seq) AS first_seq,
    sha256(string_agg({SCAN}, chr(31) ORDER BY batch_pos)) AS transaction_id FROM batched GROUP BY batch_id),
batches AS (SELECT s.*, h.device_id, h.first_epc, h.first_rssi, coalesce(g.brand_name, 'RFID Reader') AS location,
    strftime(s.sent, '%Y-%m-%dT%H:%M:%S.%fZ') AS sent_at
    FROM sums s JOIN heads h USING (batch_id) LEFT JOIN registry g ON g.reader_id = h.device_id)"""
PARSED = f"""WITH {BATCHES}
SELECT b.batch_id, device_id, location, transaction_id, sent_at, CAST(n AS INTEGER) AS tag_count,
    CAST(batch_pos - 1 AS INTEGER) AS pos, epc, coalesce(tid, '') AS tid, antenna_port AS antenna, {R2} AS rssi,
    read_count, strftime(eval_ts, '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM batched b JOIN batches USING (batch_id)"""
FORM_TEXT = f"""concat('deviceId=', device_id, '&transactionId=', transaction_id, '&epc=', first_epc, '&rssi=',
    {_number('first_rssi')})"""
FORM = f"WITH {BATCHES} SELECT batch_id, {FORM_TEXT} AS payload FROM batches"
CSV = f"""WITH {BATCHES} SELECT batch_id, 'EPC,TID,AntennaPort,RSSI,FirstSeenTime' || chr(10) || string_agg(
    concat(epc, ',', coalesce(tid, ''), ',', antenna_port, ',', {_number('rssi')}, ',',
    strftime(eval_ts, '%Y-%m-%d %H:%M:%SZ'), chr(10)), '' ORDER BY batch_pos) AS payload FROM batched GROUP BY batch_id"""
TEMPLATE = f"""WITH {BATCHES}, rows AS (SELECT batch_id, string_agg(concat('{{"epc":"', epc, '","rssi":', {_number('rssi')},
    ',"at":"', strftime(eval_ts, '%Y-%m-%dT%H:%M:%SZ'), '"}}'), ',' ORDER BY batch_pos) AS body FROM batched GROUP BY batch_id)
SELECT batch_id, concat('{{"gate":"', device_id, '","tx":"', transaction_id, '","n":', n, ',"reads":[', chr(10), body, ']}}')
    AS payload FROM batches JOIN rows USING (batch_id)"""
HEADERS = f"""WITH {BATCHES} SELECT batch_id, h.name, CASE h.name WHEN 'Content-Type' THEN 'text/plain'
    WHEN 'x-tx' THEN concat('id=', transaction_id) WHEN 'X-Gate' THEN 'north' ELSE transaction_id END AS value
FROM batches, (VALUES ('Content-Type'), ('x-tx'), ('X-Gate'), ('X-Idempotency-Key')) h(name)"""
REQUESTS = f"""WITH {BATCHES}, p AS (SELECT *, {FORM_TEXT} AS payload, CAST(batch_id AS BIGINT) % 2 = 0 AS is_get FROM batches)
SELECT batch_id, CASE WHEN is_get THEN 'GET' ELSE 'POST' END AS http_method,
    CASE WHEN is_get THEN concat('https://example.org/api?site=7&', payload, '#top')
         ELSE 'https://example.org/api?site=7#top' END AS url,
    CASE WHEN NOT is_get THEN 'text/plain' END AS content_type, CASE WHEN NOT is_get THEN payload END AS body,
    CAST(3 AS INTEGER) AS n_headers FROM p"""
CHOSEN = f"""WITH {READS}, {POSITIONS}, {COUNTED} SELECT batch_id, CAST(batch_pos - 1 AS INTEGER) AS pos,
    concat('{{"epc":"', epc, '","readerId":"', reader_id, '","antenna":', antenna_port, '}}') AS tag_json FROM batched"""
SCANS = f"WITH {READS} SELECT seq, {SCAN} AS scan_id FROM reads"
TRANSACTIONS = f"WITH {BATCHES} SELECT batch_id, transaction_id FROM batches"

# -- outbox

OUTBOX = f"""{READS}, {POSITIONS}, {COUNTED}, outbox AS (
    SELECT CAST(batch_id AS BIGINT) + 1 AS id, concat('tx-', batch_id) AS transaction_id,
        concat('https://example.org/', CAST(batch_id AS BIGINT) % 3) AS target_url,
        CAST(count(*) AS INTEGER) AS tag_count, max(eval_ts) AS created_at FROM batched GROUP BY batch_id),
    pending AS (SELECT *, CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE 2 END AS INTEGER) AS retry_count FROM outbox
        WHERE id % 4 = 0 OR id % 3 = 0)"""
PENDING = f"""WITH {OUTBOX} SELECT id, transaction_id, tag_count, retry_count, epoch_us(created_at) AS created_at FROM pending"""
PEEK = f"WITH {OUTBOX} SELECT id, transaction_id FROM pending ORDER BY id LIMIT 20"
SPILLED = f"""WITH {BATCHES} SELECT row_number() OVER (ORDER BY first_seq) AS id, transaction_id, 'POST' AS http_method,
    CAST(n AS INTEGER) AS tag_count, epoch_us(sent) AS created_at, CAST(0 AS INTEGER) AS retry_count
FROM batches WHERE CAST(batch_id AS BIGINT) % 7 = 0"""
_DRAIN = """SELECT o.id{extra}, CASE WHEN f.id IS NULL OR o.id < f.id THEN 'delivered' WHEN o.id = f.id THEN 'failed'
    ELSE 'waiting' END AS replay_state FROM outbox o LEFT JOIN f ON {on}"""
DRAIN = f"""WITH {OUTBOX}, f AS (SELECT min(id) AS id FROM outbox WHERE id % 97 = 0 AND id >= 120)
{_DRAIN.format(extra='', on='true')}"""
DRAIN_TARGET = f"""WITH {OUTBOX}, f AS (SELECT target_url, min(id) AS id FROM outbox WHERE id % 97 = 0 AND id >= 120
    GROUP BY target_url) {_DRAIN.format(extra=', o.target_url', on='o.target_url = f.target_url')}"""
WAVES = f"""WITH {OUTBOX}, f AS (SELECT target_url, min(id) AS id FROM outbox WHERE id % 97 = 0 AND id >= 120
    GROUP BY target_url) SELECT o.id, o.id IS DISTINCT FROM f.id AS is_success,
    CAST(CASE WHEN o.id = f.id THEN 503 ELSE 200 END AS INTEGER) AS http_status,
    CASE WHEN o.id = f.id THEN 'HTTP 503' END AS error_message
FROM outbox o LEFT JOIN f ON o.target_url = f.target_url WHERE f.id IS NULL OR o.id <= f.id"""
SLOTS = f"""WITH {OUTBOX} SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT) AS send_slot FROM pending"""
DISPATCHED = f"""WITH {BATCHES} SELECT transaction_id, transaction_id[1] NOT IN ('0', '1') AS is_success,
    CAST(CASE transaction_id[1] WHEN '0' THEN 503 WHEN '1' THEN 0 ELSE 200 END AS INTEGER) AS http_status,
    CASE transaction_id[1] WHEN '0' THEN 'busy' WHEN '1' THEN NULL
         ELSE concat(length({FORM_TEXT}), ' bytes') END AS response,
    CASE transaction_id[1] WHEN '0' THEN 'HTTP 503' WHEN '1' THEN 'connection reset' END AS error_message FROM batches"""
UPSERT = f"WITH {OUTBOX} SELECT transaction_id, id, tag_count FROM outbox WHERE id % 4 = 0 OR id % 3 = 0"

# -- telemetry

LATEST_STATUS = f"""WITH {STATUS}, {REGISTRY}, s AS (SELECT seq, ts, new_state,
    CASE WHEN reader_id IN ('reader-3', 'reader-4') THEN 'reader-x' ELSE reader_id END AS reader_id FROM status),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY seq DESC) = 1)
SELECT coalesce(l.reader_id, g.reader_id) AS reader_id, coalesce(provider_id, 'Unknown') AS provider_id,
    coalesce(new_state, 'Disconnected') AS state, coalesce(epoch_us(ts), 0) AS last_seen
FROM last l FULL OUTER JOIN registry g ON l.reader_id = g.reader_id"""
HEALTH = f"""WITH {CHAIN}, {REGISTRY}, {STATUS}, {POSITIONS}, {COUNTED},
last AS (SELECT reader_id, new_state FROM status QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY seq DESC) = 1),
known AS (SELECT reader_id FROM registry UNION SELECT reader_id FROM status)
SELECT (SELECT count(*) FROM last WHERE new_state = 'Connected') AS connected_readers,
    (SELECT count(*) FROM known) AS total_readers, (SELECT count(*) FROM reads) AS raw_reads,
    (SELECT count(*) FROM survivors) AS filtered_reads,
    (SELECT count(*) FROM (SELECT DISTINCT CAST(batch_id AS BIGINT) + 1 AS id FROM batched)
     WHERE id % 4 = 0 OR id % 3 = 0) AS queued_batches,
    CAST((SELECT count(*) FROM known) AS INTEGER) AS listed_readers"""
RECONNECTS = f"""WITH {STATUS},
coarse AS (SELECT seq * 2 AS seq, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS half, reader_id, new_state FROM status),
doubled AS (SELECT * FROM coarse UNION ALL SELECT seq + 1 AS seq, half, reader_id, new_state FROM coarse WHERE seq % 6 = 0),
events_once AS (SELECT seq, reader_id, new_state FROM doubled
    QUALIFY row(half, new_state) IS DISTINCT FROM lag(row(half, new_state)) OVER (PARTITION BY reader_id ORDER BY seq)),
n AS (SELECT s.seq, s.reader_id, (SELECT count(*) FROM events_once p
    WHERE p.reader_id = s.reader_id AND p.new_state = 'Reconnecting' AND p.seq <= s.seq AND p.seq > coalesce(
        (SELECT max(c.seq) FROM events_once c WHERE c.reader_id = s.reader_id AND c.new_state = 'Connected' AND c.seq < s.seq), -1))
    AS attempt FROM events_once s WHERE s.new_state = 'Reconnecting')
SELECT seq, reader_id, attempt, CAST(least(1000 * pow(2, least(attempt - 1, 10)), 60000) AS DOUBLE) AS delay_ms FROM n"""
FEED = f"WITH {CHAIN} SELECT seq, 'raw' AS feed FROM reads UNION ALL SELECT seq, 'filtered' AS feed FROM survivors"
LATEST = f"""WITH {READS} SELECT seq, epc, reader_id, epoch_us(eval_ts) AS eval_ts FROM reads ORDER BY seq DESC LIMIT 50"""
QUALITY = f"""WITH {READS} SELECT seq,
    round(greatest(0.0, least(100.0, (CAST(rssi AS DOUBLE) + 100) * 1.25)), 1) AS quality_pct FROM reads"""
THROUGHPUT = f"""WITH {READS} SELECT epoch_us(date_trunc('second', eval_ts)) AS second, count(*) AS reads FROM reads GROUP BY 1"""
ANTENNAS = f"""WITH {READS} SELECT reader_id, antenna_port, count(*) AS reads, round(avg(CAST(rssi AS DOUBLE)), 2) AS avg_rssi
FROM reads GROUP BY reader_id, antenna_port"""
SKEW = f"""WITH {READS}, s AS (SELECT reader_id, ((seq * 7919) % 20011 - 10000) * 1000 AS skew_us FROM reads)
SELECT reader_id, count(*) AS reads, min(skew_us) AS min_skew_us, max(skew_us) AS max_skew_us,
    quantile_disc(skew_us, 0.5) AS median_skew_us FROM s GROUP BY reader_id"""
REGEX = f"""WITH {READS} SELECT seq, epc, substr(epc, 22, 1) = '0' AND substr(epc, 23, 1) BETWEEN '0' AND '4'
    AND substr(epc, 24, 1) IN ('A', 'B', 'C') AS is_match FROM reads"""

# -- streams

CLOSED_SECONDS = f"""WITH {READS}, s AS (SELECT epoch_us(date_trunc('second', eval_ts)) AS second, count(*) AS reads FROM reads GROUP BY 1)
SELECT * FROM s WHERE second + 1000000 <= (SELECT floor(max(epoch_us(eval_ts)) / 1000) * 1000 FROM reads) - 10000000"""
LAST_STATES = f"""WITH {STATUS} SELECT reader_id, new_state AS state, epoch_us(ts) AS last_seen FROM status
QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY seq DESC) = 1"""
ENDED_LINES = LINES.replace("trim(line) AS line", "trim(line) AS line, false AS quarantined").replace("line <> '' OR ", "")
CLOSED = f"""WITH {READS}, n AS (SELECT seq, {TICK} AS tick, row_number() OVER (PARTITION BY {TICK} ORDER BY seq) AS i FROM reads)
SELECT seq, concat(tick, '-', CAST(floor((i - 1) / 20) AS BIGINT)) AS batch_id, (i - 1) % 20 + 1 AS batch_pos FROM n"""

ORACLES: dict[str, str] = {
    "decode_text_lines": DECODED_TEXT,
    "decode_mqtt_messages": DECODED_MQTT,
    "decode_identium_frames": DECODED_FRAMES,
    "decode_llrp_reports": DECODED_REPORTS,
    "split_llrp_capture": CAPTURE_FRAMES,
    "split_capture_files": CAPTURE_FILES,
    "decode_vendor_reports": VENDOR,
    "split_lines": LINES,
    "route_by_provider": ROUTED,
    "normalize_reads": NORMALIZED,
    "filter_min_rssi": _filter("rssi >= CAST(-75 AS FLOAT)"),
    "filter_antenna_mask": _filter("antenna_port IN (1, 3)"),
    "filter_epc_length": _filter("length(epc) BETWEEN 10 AND 24"),
    "filter_epc_prefix": _filter("lower(epc) LIKE 'e280%'"),
    "filter_epc_suffix": _filter("lower(epc) LIKE '%a'"),
    "filter_epc_regex": _filter("regexp_matches(epc, '0[0-7]F$')"),
    "metadata_filter": METADATA,
    "schedule_days": _filter(f"dayofweek({LOCAL}) IN (1, 3, 5)"),
    "schedule_time_window": _filter(f"{TIME} BETWEEN TIME '08:00:00' AND TIME '18:00:00'"),
    "schedule_filter": SCHEDULE,
    "sliding_dedup": SLIDING,
    "sliding_dedup_reader": SLIDING_READER,
    "sliding_dedup_antenna": SLIDING_ANTENNA,
    "shift_id": SHIFT_IDS,
    "daily_unique": DAILY,
    "decode_then_daily_unique": DECODED_DAILY,
    "shift_rollovers": ROLLOVERS,
    "active_key_counts": ACTIVE,
    "live_sliding_keys": LIVE,
    "lineitem_shift_counts": LINEITEM_SHIFTS,
    "filter_pipeline": OTHER_CHAIN,
    "default_pipeline": DEFAULT_CHAIN,
    "pipeline_counters": COUNTERS,
    "drop_report": DROPS,
    "custom_stage": CUSTOM,
    "enrich_with_reader": ENRICHED,
    "status_with_provider": STATUS_PROVIDER,
    "batch_instant": INSTANT,
    "batch_periodic": PERIODIC,
    "batch_count": COUNT,
    "batch_hybrid": HYBRID,
    "render_json_payload": PARSED,
    "render_form_payload": FORM,
    "render_csv_payload": CSV,
    "render_xml_payload": PARSED,
    "render_template": TEMPLATE,
    "inject_headers": HEADERS,
    "build_requests": REQUESTS,
    "select_tag_fields": CHOSEN,
    "tag_scan_id": SCANS,
    "batch_transaction_id": TRANSACTIONS,
    "outbox_pending": PENDING,
    "outbox_peek": PEEK,
    "spill_failed": SPILLED,
    "replay_drain": DRAIN,
    "replay_drain_target": DRAIN_TARGET,
    "replay_waves": WAVES,
    "replay_schedule": SLOTS,
    "dispatch_requests": DISPATCHED,
    "idempotent_upsert": UPSERT,
    "latest_reader_status": LATEST_STATUS,
    "health_summary": HEALTH,
    "reconnect_plan": RECONNECTS,
    "telemetry_feed": FEED,
    "latest_reads": LATEST,
    "rssi_quality_pct": QUALITY,
    "throughput_per_second": THROUGHPUT,
    "antenna_distribution": ANTENNAS,
    "clock_skew": SKEW,
    "regex_test": REGEX,
    "sliding_dedup_stream": SLIDING,
    "daily_unique_stream": DAILY,
    "filter_pipeline_stream": DROPS,
    "batch_stream": CLOSED,
    "throughput_stream": CLOSED_SECONDS,
    "reader_status_stream": LAST_STATES,
    "split_lines_stream": ENDED_LINES,
}
