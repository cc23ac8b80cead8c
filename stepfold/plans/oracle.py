"""The registered queries in plain SQL, one statement each, on the same tables.

These say what is computed in the most direct form, with one window per signal and joins without
tiles or salts, and so check that the scalable form gives the same rows.
"""

from __future__ import annotations

RAW = """raw AS (
  SELECT 't' AS trace_id, CAST(user_id + 1 AS BIGINT) AS storage_id,
         CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS cycle, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS raw_bits,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS TINYINT) AS state, event_type
  FROM events)"""
SMALL_RAW = "small_raw AS (SELECT * REPLACE (raw_bits % 4 AS raw_bits) FROM raw)"
FLAG_RAW = """flag_raw AS (SELECT * REPLACE (CAST(event_type = 'purchase' AS BIGINT) AS raw_bits, CAST(0 AS TINYINT) AS state)
  FROM raw)"""
WIDE_RAW = """wide_raw AS (SELECT * REPLACE (CASE WHEN state = 0 THEN raw_bits * 1000003 - 25000000000 ELSE raw_bits END AS raw_bits)
  FROM raw)"""
RERUN_RAW = """rerun_raw AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 AND state = 0 THEN (raw_bits + 1) % 4 ELSE raw_bits END AS raw_bits)
  FROM small_raw WHERE seq % 97 <> 0 AND (storage_id - 1) % 50 <> 7)"""


def over(partition: str, order: str) -> str:
    return f"OVER (PARTITION BY {partition} ORDER BY {order})"


def changed(partition: str, order: str = "cycle") -> str:
    w = over(partition, order)
    return (f"(lag(state) {w} IS NULL OR lag(state) {w} <> state OR lag(raw_bits) {w} <> raw_bits)")


def last_writes(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT trace_id, storage_id AS signal_id, cycle, arg_max(raw_bits, seq) AS raw_bits, arg_max(state, seq) AS state
  FROM {source} GROUP BY ALL)"""


def no_repeats(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT trace_id, signal_id, cycle, raw_bits, state FROM {source} QUALIFY {changed('trace_id, signal_id')})"""


def compacted(name: str, source: str) -> list[str]:
    return [last_writes(f"{name}_w", source), no_repeats(name, f"{name}_w")]


FULL = [RAW, *compacted("full_t", "raw")]
SMALL = [RAW, SMALL_RAW, *compacted("small_t", "small_raw")]
RERUN = [*SMALL, RERUN_RAW, *compacted("rerun_t", "rerun_raw")]
FLAG = [RAW, FLAG_RAW, *compacted("flag_t", "flag_raw")]
WIDE = [RAW, WIDE_RAW, *compacted("wide_t", "wide_raw")]
META = "meta AS (SELECT trace_id, max(cycle) + 1 AS tend FROM raw GROUP BY trace_id)"


def layout(width: int, name: str = "layout") -> str:
    kind = "bit" if width == 1 else "bus"
    return f"""{name} AS (
  SELECT DISTINCT 't' AS trace_id, CAST(user_id + 1 AS BIGINT) AS signal_id, 'u' || (user_id + 1) AS name,
         'top.g' || ((user_id + 1) % 8) || '.u' || (user_id + 1) AS path, '{kind}' AS kind, {width} AS width FROM events)"""


PROBES = """probes AS (
  SELECT 't' AS trace_id, CAST(o_custkey // 10 + 1 AS BIGINT) AS signal_id,
         CAST((((CAST(o_orderdate AS DATE) - DATE '2024-01-01') * 86400) % 2592000 + 2592000) % 2592000
              + o_orderkey % 86400 AS BIGINT) AS cycle
  FROM orders)"""
PAIRS = "pairs AS (SELECT trace_id, (signal_id + 1) // 2 AS group_id, (signal_id + 1) % 2 AS slot, signal_id FROM layout)"
NODES = """nodes AS (
  SELECT 1::BIGINT AS node_id, 0::BIGINT AS parent_id, 0 AS ordinal, 'top' AS name, 'Root' AS node_kind
  UNION ALL SELECT 2 + r_regionkey, 1, r_regionkey, r_name, 'Object' FROM region
  UNION ALL SELECT 100 + n_nationkey, 2 + n_regionkey, n_nationkey, n_name, 'Object' FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, c_custkey, c_name, 'SignalLeaf' FROM customer)"""
TREE = """tree AS (
  SELECT node_id, parent_id, ordinal, name, node_kind, name AS path, 0 AS depth, CAST([] AS BIGINT[]) AS anc
  FROM nodes WHERE parent_id = 0
  UNION ALL
  SELECT n.node_id, n.parent_id, n.ordinal, n.name, n.node_kind, t.path || '.' || n.name, t.depth + 1, list_append(t.anc, t.node_id)
  FROM nodes n JOIN tree t ON n.parent_id = t.node_id)"""
NAMED = """named AS (
  SELECT *, CASE WHEN node_kind = 'SignalLeaf' THEN name || '[15:0]' ELSE name END AS shown FROM nodes)"""
CLOSURE = "closure AS (SELECT node_id, unnest(list_append(anc, node_id)) AS root, node_kind FROM tree)"
SEARCHED = "searched AS (SELECT node_id FROM named WHERE contains(lower(shown), 'nation_2'))"

SPAN, CHUNK, LO, HI = 259_200, 128, 86_400, 172_800


def sql(ctes: list[str], body: str, recursive: bool = False) -> str:
    seen = list(dict.fromkeys(ctes))
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(seen) + "\n" + body


def tiled(source: str) -> str:
    return f"(SELECT *, cycle // {SPAN} AS time_block, (signal_id - 1) // {CHUNK} AS signal_chunk FROM {source})"


def tile_index(source: str, layouts: str, name: str = "idx") -> str:
    return f"""{name} AS (
  SELECT t.trace_id, t.time_block, t.signal_chunk, t.time_block * {SPAN} AS start_cycle,
         CASE WHEN t.time_block = m.last_cycle // {SPAN} THEN m.last_cycle + 1 ELSE (t.time_block + 1) * {SPAN} END AS end_cycle,
         t.signal_chunk * {CHUNK} + 1 AS first_signal_id,
         least({CHUNK}, l.max_id - t.signal_chunk * {CHUNK}) AS signal_count,
         t.active_signals, t.records, t.change_times
  FROM (SELECT trace_id, time_block, signal_chunk, count(DISTINCT signal_id) AS active_signals, count(*) AS records,
               count(DISTINCT cycle) AS change_times
        FROM {tiled(source)} GROUP BY ALL) t
  JOIN (SELECT trace_id, max(cycle) AS last_cycle FROM {source} GROUP BY ALL) m USING (trace_id)
  JOIN (SELECT trace_id, max(signal_id) AS max_id FROM {layouts} GROUP BY ALL) l USING (trace_id))"""


def held(column: str, partition: str) -> str:
    return f"last_value({column} IGNORE NULLS) OVER (PARTITION BY {partition} ORDER BY cycle)"


DIFF = [
    *RERUN, layout(2),
    """right_layout AS (SELECT * REPLACE (CASE WHEN signal_id = 3 THEN 3 ELSE width END AS width) FROM layout
  WHERE (signal_id - 1) % 50 <> 7)""",
    "ends AS (SELECT max(cycle) + 1 AS a_end, max(cycle) + 1 - 86400 AS b_end FROM small_raw)",
    "both_sides AS (SELECT l.path, l.signal_id, l.width = r.width AS ok FROM layout l JOIN right_layout r USING (path))",
    """times AS (
  SELECT path, cycle, max(ab) AS ab, max(ast) AS ast, max(bb) AS bb, max(bst) AS bst FROM (
    SELECT p.path, a.cycle, a.raw_bits AS ab, a.state AS ast, NULL AS bb, NULL AS bst
      FROM small_t a JOIN both_sides p USING (signal_id), ends WHERE p.ok AND a.cycle < a_end
    UNION ALL SELECT p.path, b.cycle, NULL, NULL, b.raw_bits, b.state
      FROM rerun_t b JOIN both_sides p USING (signal_id), ends WHERE p.ok AND b.cycle < b_end
    UNION ALL SELECT p.path, b_end, NULL, NULL, 0, 2 FROM both_sides p, ends WHERE p.ok)
  GROUP BY path, cycle)""",
    f"""states AS (
  SELECT path, cycle, coalesce({held('ab', 'path')}, 0) AS ab, coalesce({held('ast', 'path')}, 2) AS ast,
         coalesce({held('bb', 'path')}, 0) AS bb, coalesce({held('bst', 'path')}, 2) AS bst,
         coalesce(lead(cycle) OVER (PARTITION BY path ORDER BY cycle), a_end) AS until
  FROM times, ends)""",
    """parts AS (
  SELECT path, cycle, until, sum(CASE WHEN before = cycle THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY cycle) AS island
  FROM (SELECT path, cycle, until, lag(until) OVER (PARTITION BY path ORDER BY cycle) AS before
        FROM states WHERE ab <> bb OR ast <> bst))""",
    """regions AS (
  SELECT path, min(cycle) AS "start", max(until) AS "end" FROM parts GROUP BY path, island
  UNION ALL SELECT path, 0, a_end FROM both_sides, ends WHERE NOT ok)""",
]

COMPARED = [
    *DIFF,
    """picked AS (
  SELECT path, signal_id AS source_id, width_a, width_b, row_number() OVER (ORDER BY signal_id) AS rank
  FROM (SELECT l.path, l.signal_id, l.width AS width_a, r.width AS width_b
        FROM layout l JOIN right_layout r USING (path) WHERE path IN (SELECT path FROM regions)))""",
    """compared AS (
  SELECT path, 'a' AS side, regexp_replace(path, '^(.*\\.)([^.]*)$', '\\1A \\2') AS side_path, source_id, 'bus' AS kind,
         width_a AS width, 2 * rank - 1 AS signal_id FROM picked
  UNION ALL SELECT path, 'b', regexp_replace(path, '^(.*\\.)([^.]*)$', '\\1B \\2'), source_id, 'bus', width_b, 2 * rank
  FROM picked)""",
]


def hits(layouts: str, target: str) -> str:
    """Run starts of a value, given as SQL over the layout's width."""
    p = "PARTITION BY trace_id, signal_id ORDER BY cycle"
    return f"""hits AS (
  SELECT trace_id, signal_id, cycle, sample_index FROM (
    SELECT trace_id, signal_id, cycle, hit, row_number() OVER ({p}) - 1 AS sample_index,
           coalesce(lag(hit) OVER ({p}), false) AS was
    FROM (SELECT t.*, t.state = 0 AND (t.raw_bits & ((1 << l.width) - 1)) = ({target}) AS hit
          FROM small_t t JOIN {layouts} l USING (trace_id, signal_id) WHERE ({target}) IS NOT NULL))
  WHERE hit AND NOT was)"""


MIXED = "mixed AS (SELECT * REPLACE (CASE WHEN signal_id % 5 = 0 THEN 1 ELSE width END AS width) FROM layout)"
SUMMARY = [
    *SMALL, layout(2), MIXED, hits("mixed", "CASE WHEN l.width > 1 THEN 2 END"),
    """summary AS (
  SELECT m.trace_id, m.signal_id, m.path, coalesce(h.n, 0) AS hits, coalesce(CAST(h.f AS VARCHAR), '-') AS first_time,
         coalesce(s.n, 0) AS samples, m.width < 2 AS width_skipped
  FROM mixed m LEFT JOIN (SELECT signal_id, count(*) AS n, min(cycle) AS f FROM hits GROUP BY ALL) h USING (signal_id)
  LEFT JOIN (SELECT signal_id, count(*) AS n FROM small_t GROUP BY ALL) s USING (signal_id))""",
]
MARKS = """marks AS (
  SELECT trace_id, cycle FROM small_t QUALIFY lag(state) OVER (PARTITION BY trace_id, signal_id ORDER BY cycle) IS NOT NULL)"""


def neighbour(marks: str, how: str, op: str) -> str:
    return f"""SELECT p.trace_id, p.cycle, m.cycle AS target
FROM (SELECT DISTINCT trace_id, cycle FROM probes) p
ASOF JOIN (SELECT DISTINCT cycle FROM {marks}) m ON p.cycle {op} m.cycle"""


def pyramid(source: str = "full_t", base: int = 256) -> str:
    levels = "\n  UNION ALL ".join(
        f"SELECT trace_id, signal_id, {k} AS level, CAST({base * 5 ** k} AS BIGINT) AS bucket, cycle // {base * 5 ** k} * {base * 5 ** k} "
        f"AS window_start, max(cycle) AS cycle, arg_max(raw_bits, cycle) AS raw_bits, arg_max(state, cycle) AS state "
        f"FROM {source} GROUP BY trace_id, signal_id, window_start" for k in range(7))
    return f"pyramid AS (\n  {levels})"


def kept_levels(minimum: int) -> list[str]:
    """The greedy choice of levels, one step per level."""
    steps = ["""level_counts AS (
  SELECT trace_id, signal_id, level, bucket, count(*) AS n FROM pyramid GROUP BY ALL)""",
             f"""step_0 AS (SELECT trace_id, signal_id, count(*) AS last FROM full_t GROUP BY ALL HAVING count(*) >= {minimum})"""]
    for k in range(7):
        steps.append(f"""step_{k + 1} AS (
  SELECT s.trace_id, s.signal_id, s.last AS source, c.n, c.bucket, c.n IS NOT NULL AND c.n <= s.last // 5 AS kept,
         CASE WHEN c.n IS NOT NULL AND c.n <= s.last // 5 THEN c.n ELSE s.last END AS last
  FROM step_{k} s LEFT JOIN level_counts c ON c.signal_id = s.signal_id AND c.level = {k})""")
    return steps


def mask_sql() -> str:
    return "CASE WHEN state = 2 THEN 8 WHEN state = 1 THEN 4 WHEN raw_bits = 0 THEN 1 ELSE 2 END"


def raster(source: str, t0: int, t1: int | str, width: int) -> list[str]:
    """``t1`` may be tend, the end of the trace."""
    span = f"({t1} - {t0})"
    col = f"CAST((({{0}} - {t0}) * {2 * width} + {span}) // (2 * {span}) AS INTEGER)"
    w = "OVER (PARTITION BY trace_id, signal_id ORDER BY cycle)"
    return [META, f"""seg AS (
  SELECT trace_id, signal_id, cycle, tend, least(coalesce(lead(cycle) {w}, tend), tend) AS stop, {mask_sql()} AS mask,
         lag({mask_sql()}) {w} AS prev_mask
  FROM {source} JOIN meta USING (trace_id))""", f"""placed AS (
  SELECT trace_id, signal_id, mask, {col.format(f'greatest(cycle, {t0})')} AS x1, {col.format(f'least(stop, {t1})')} AS x2,
         cycle >= {t0} AND prev_mask IS NOT NULL AND prev_mask <> mask AS edge
  FROM seg WHERE stop > cycle AND stop > {t0} AND cycle < {t1})""", f"""cells AS (
  SELECT trace_id, signal_id, unnest(range(x1, x2)) AS x, mask, 0 AS change FROM placed WHERE x2 > x1
  UNION ALL SELECT trace_id, signal_id, x1, 0, 1 FROM placed WHERE edge AND x1 < {width})"""]


RASTER_BODY = """SELECT trace_id, signal_id, CAST(x AS INTEGER) AS x, CAST(bit_or(mask) AS INTEGER) AS state_mask,
  CAST(sum(change) AS BIGINT) AS changes FROM cells GROUP BY trace_id, signal_id, x"""

OPEN_END = (1 << 63) - 1
RANGES = [
    """gaps AS (
  SELECT trace_id, signal_id, level, bucket, window_start,
         lag(window_start) OVER (PARTITION BY trace_id, signal_id, level ORDER BY window_start) AS before,
         lead(window_start) OVER (PARTITION BY trace_id, signal_id, level ORDER BY window_start) IS NULL AS is_last
  FROM pyramid)""",
    """islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR window_start - before > greatest(8 * bucket, bucket + 1) THEN 1 ELSE 0 END)
            OVER (PARTITION BY trace_id, signal_id, level ORDER BY window_start) AS island FROM gaps)""",
    f"""ranges AS (
  SELECT trace_id, signal_id, level, bucket, min(window_start) AS "start",
         CASE WHEN bool_or(is_last) THEN {OPEN_END} ELSE max(window_start) + bucket END AS "end"
  FROM islands GROUP BY trace_id, signal_id, level, bucket, island HAVING count(*) > 1)""",
]

DOCS = [RAW, """items AS (
  SELECT 'u' || storage_id || '.d' || (cycle // 86400) AS trace_id, cycle // 86400 AS day, cycle, seq AS event,
         row_number() OVER (PARTITION BY storage_id, cycle // 86400 ORDER BY seq) - 1 AS seq,
         seq % 53 = 0 AS bad_time, seq % 7 AS form, raw_bits, state FROM raw)"""]

TEXTS = [RAW, """texts AS (
  SELECT seq, CASE WHEN storage_id % 3 = 0 THEN 'bit' ELSE 'bus' END AS kind,
         CASE storage_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 12 END AS width,
         CASE seq % 12 WHEN 0 THEN CAST(raw_bits AS VARCHAR) WHEN 1 THEN '0x' || lower(hex(raw_bits))
           WHEN 2 THEN '0B' || bin(raw_bits) WHEN 3 THEN hex(raw_bits) WHEN 4 THEN ' ' || raw_bits || ' ' WHEN 5 THEN 'Z'
           WHEN 6 THEN '' WHEN 7 THEN '__ABSENT__'
           WHEN 8 THEN '184467440737095' || lpad(CAST(raw_bits % 100000 AS VARCHAR), 5, '0')
           WHEN 9 THEN '0xF' || lpad(hex(raw_bits), 15, '0') WHEN 10 THEN '1' ELSE raw_bits || 'xg' END AS value FROM raw)"""]


def to_signed(unsigned: str) -> str:
    return f"CAST(CASE WHEN ({unsigned}) >= 9223372036854775808 THEN ({unsigned}) - 18446744073709551616 ELSE ({unsigned}) END AS BIGINT)"


def u64(pattern: str) -> str:
    return f"CASE WHEN {pattern} < 0 THEN {pattern}::HUGEINT + 18446744073709551616 ELSE {pattern}::HUGEINT END"


RADIX = [*WIDE, layout(64), """radixed AS (
  SELECT trace_id, signal_id, ['bin','hex','dec','int','uint','int64','uint64'][signal_id % 7 + 1] AS radix,
         [64, 32, 12, 16][signal_id % 4 + 1] AS width FROM layout)""",
    f"""shown AS (
  SELECT t.trace_id, t.signal_id, cycle, state, radix, width, ({u64('raw_bits')}) % (1::HUGEINT << width) AS u
  FROM wide_t t JOIN radixed USING (trace_id, signal_id))"""]

UPDATES = [RAW, """odd AS (
  SELECT trace_id, CASE WHEN seq % 83 = 0 THEN storage_id + 7000000 ELSE storage_id END AS storage_id,
         CASE WHEN seq % 89 = 0 THEN -(cycle // 3600) - 1 ELSE cycle // 3600 END AS cycle, seq,
         CASE WHEN seq % 79 = 0 THEN raw_bits + 65536 ELSE raw_bits END AS raw_bits, state FROM raw)"""]

BROKEN = [
    NODES, """bad_once AS (
  SELECT node_id, CAST(CASE WHEN node_kind <> 'SignalLeaf' THEN parent_id
           WHEN (node_id - 1000) % 101 = 1 THEN 999999999 WHEN (node_id - 1000) % 101 = 2 THEN node_id
           WHEN (node_id - 1000) % 101 = 3 THEN node_id + 1 WHEN (node_id - 1000) % 101 = 4 THEN node_id - 1
           ELSE parent_id END AS BIGINT) AS parent_id,
         CASE WHEN node_kind = 'SignalLeaf' AND (node_id - 1000) % 103 = 5 THEN '' ELSE name END AS name,
         CASE WHEN node_kind = 'SignalLeaf' AND (node_id - 1000) % 107 = 6 THEN 'Leaf' ELSE node_kind END AS node_kind
  FROM nodes)""",
    """bad_nodes AS (SELECT * FROM bad_once
  UNION ALL SELECT * FROM bad_once WHERE node_kind = 'SignalLeaf' AND (node_id - 1000) % 109 = 7)""",
    """reached AS (SELECT node_id FROM bad_nodes WHERE parent_id = 0
  UNION SELECT n.node_id FROM bad_nodes n JOIN reached r ON n.parent_id = r.node_id)""",
    layout(16), """bad_signals AS (
  SELECT signal_id AS i, signal_id,
         CAST(CASE WHEN signal_id % 11 = 0 THEN 5 WHEN signal_id % 13 = 0 THEN 888888888 ELSE signal_id + 999 END AS BIGINT) AS node_id,
         CASE WHEN signal_id % 17 = 0 THEN 65 WHEN signal_id % 19 = 0 THEN 20 ELSE 16 END AS width,
         CASE WHEN signal_id % 23 = 0 THEN 50 WHEN signal_id % 29 = 0 THEN 4 ELSE 0 END AS bit_offset,
         CASE WHEN signal_id % 31 = 0 THEN 'U128' ELSE 'U16' END AS value_type,
         CASE WHEN signal_id % 37 = 0 THEN 'octal' ELSE 'hex' END AS radix,
         CASE WHEN signal_id % 29 = 0 THEN signal_id - 1 ELSE signal_id END AS storage_id FROM layout)""",
    """owners AS (SELECT storage_id, min(signal_id) AS owner, arg_min(value_type, signal_id) AS owner_type,
         arg_min(bit_offset, signal_id) AS owner_offset FROM bad_signals GROUP BY storage_id)""",
    """bad_clocks AS (
  SELECT CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 5000000 ELSE n_nationkey // 2 + 1 END AS BIGINT) AS signal_id,
         n_nationkey % 5 AS period FROM nation)""",
]
TOPOLOGY = """SELECT 't' AS trace_id, subject_kind, CAST(subject_id AS BIGINT) AS subject_id, rule FROM (
  SELECT 'node' AS subject_kind, node_id AS subject_id, 'name_empty' AS rule FROM bad_nodes WHERE name = ''
  UNION ALL SELECT 'node', node_id, 'parent_is_self' FROM bad_nodes WHERE parent_id = node_id
  UNION ALL SELECT 'node', node_id, 'kind_invalid' FROM bad_nodes WHERE node_kind = 'Leaf'
  UNION ALL SELECT 'node', node_id, 'id_duplicate' FROM bad_nodes GROUP BY node_id HAVING count(*) > 1
  UNION ALL SELECT 'node', node_id, 'parent_missing' FROM bad_nodes
    WHERE parent_id <> 0 AND parent_id NOT IN (SELECT node_id FROM bad_nodes)
  UNION ALL SELECT 'node', node_id, 'unreachable' FROM bad_nodes WHERE node_id NOT IN (SELECT node_id FROM reached)
  UNION ALL SELECT 'signal', i, 'width_out_of_range' FROM bad_signals WHERE width > 64
  UNION ALL SELECT 'signal', i, 'type_invalid' FROM bad_signals WHERE value_type = 'U128'
  UNION ALL SELECT 'signal', i, 'width_exceeds_type' FROM bad_signals WHERE value_type = 'U16' AND width > 16
  UNION ALL SELECT 'signal', i, 'bit_range_invalid' FROM bad_signals WHERE bit_offset + width > 64
  UNION ALL SELECT 'signal', i, 'radix_invalid' FROM bad_signals WHERE radix = 'octal'
  UNION ALL SELECT 'signal', i, 'node_missing' FROM bad_signals WHERE node_id NOT IN (SELECT node_id FROM bad_nodes)
  UNION ALL SELECT 'signal', i, 'node_has_children' FROM bad_signals WHERE node_id IN (SELECT parent_id FROM bad_nodes)
  UNION ALL SELECT 'signal', i, 'node_not_leaf_kind' FROM bad_signals
    WHERE node_id IN (SELECT node_id FROM bad_nodes) AND node_id NOT IN (SELECT node_id FROM bad_nodes WHERE node_kind = 'SignalLeaf')
  UNION ALL SELECT 'signal', i, 'bit_range_beyond_storage' FROM bad_signals JOIN owners USING (storage_id)
    WHERE signal_id <> owner AND owner_type = 'U16' AND bit_offset + width > 16
  UNION ALL SELECT 'signal', owner, 'first_on_storage_has_offset' FROM owners WHERE owner_offset <> 0
  UNION ALL SELECT 'clock', signal_id, 'signal_missing' FROM bad_clocks WHERE signal_id NOT IN (SELECT signal_id FROM bad_signals)
  UNION ALL SELECT 'clock', signal_id, 'not_one_bit_bool' FROM bad_clocks WHERE signal_id IN (SELECT signal_id FROM bad_signals)
  UNION ALL SELECT 'clock', signal_id, 'period_not_positive' FROM bad_clocks WHERE period <= 0
  UNION ALL SELECT 'clock', signal_id, 'id_duplicate' FROM bad_clocks GROUP BY signal_id HAVING count(*) > 1)"""

CLOCKISH = ["""ticks AS (
  SELECT CAST(c + 1 AS BIGINT) AS signal_id, CAST(n * (100 + c % 13) + CASE WHEN c % 7 = 3 AND n = 4 THEN 1 ELSE 0 END AS BIGINT) AS cycle,
         CASE WHEN c % 11 = 5 AND n = 3 THEN 0 ELSE n % 2 END AS bit, c % 11 = 5 AND n = 3 AS is_z, c
  FROM (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders))"""]


def periodic(tolerance: int) -> list[str]:
    b = "PARTITION BY signal_id, cycle // 1000 ORDER BY cycle"
    return [*CLOCKISH, f"""marked AS (
  SELECT signal_id, cycle // 1000 AS block, cycle, bit, is_z, row_number() OVER ({b}) AS n,
         cycle - lag(cycle) OVER ({b}) AS gap, lag(bit) OVER (PARTITION BY signal_id ORDER BY cycle) AS prev_bit,
         coalesce(lag(is_z) OVER (PARTITION BY signal_id ORDER BY cycle), false) AS prev_z
  FROM ticks WHERE c % 17 <> 0)""", f"""clocks_found AS (
  SELECT signal_id, block, count(*) AS toggles, max(CASE WHEN n = 2 THEN gap END) AS half,
         bool_and(NOT is_z AND NOT prev_z AND bit <> coalesce(prev_bit, 0)) AS good, min(cycle) AS first_cycle,
         max(CASE WHEN n = 1 THEN coalesce(prev_bit, 0) END) AS initial_bits, min(gap) AS least, max(gap) AS most
  FROM marked GROUP BY signal_id, block HAVING count(*) >= 6)""", f"""clocks_kept AS (
  SELECT * FROM clocks_found WHERE good AND most - half <= {tolerance} AND half - least <= {tolerance})"""]


PERIODIC_BODY = """SELECT 't' AS trace_id, signal_id, block, CAST(initial_bits AS BIGINT) AS initial_bits,
  first_cycle - block * 1000 AS first_offset, half AS half_period, toggles FROM clocks_kept"""


def derived(source: str, expression: str) -> list[str]:
    """Two operands a and b as unsigned values; ``expression`` is NULL when not known."""
    p = "trace_id, group_id"
    return [layout(16), PAIRS, f"""merged AS (
  SELECT trace_id, group_id, cycle, max(CASE WHEN slot = 0 THEN raw_bits END) AS b0, max(CASE WHEN slot = 0 THEN state END) AS s0,
         max(CASE WHEN slot = 1 THEN raw_bits END) AS b1, max(CASE WHEN slot = 1 THEN state END) AS s1
  FROM (SELECT p.trace_id, p.group_id, t.cycle, p.slot, t.raw_bits, t.state FROM {source} t JOIN pairs p USING (trace_id, signal_id)
        UNION ALL SELECT DISTINCT trace_id, group_id, 0::BIGINT, NULL, NULL, NULL FROM pairs) GROUP BY trace_id, group_id, cycle)""",
        f"""operands AS (
  SELECT trace_id, group_id, cycle, CASE WHEN s0 = 0 THEN {u64('b0')} END AS a, CASE WHEN s1 = 0 THEN {u64('b1')} END AS b
  FROM (SELECT trace_id, group_id, cycle, {held('b0', p)} AS b0, {held('s0', p)} AS s0, {held('b1', p)} AS b1, {held('s1', p)} AS s1
        FROM merged))""",
        f"valued AS (SELECT trace_id, group_id, cycle, {expression} AS v FROM operands)"]


DERIVED_BODY = f"""SELECT trace_id, group_id, cycle, coalesce({to_signed('v')}, 0) AS raw_bits,
  CAST(CASE WHEN v IS NULL THEN 1 ELSE 0 END AS TINYINT) AS state
FROM valued QUALIFY row_number() OVER (PARTITION BY trace_id, group_id ORDER BY cycle) = 1
  OR v IS DISTINCT FROM lag(v) OVER (PARTITION BY trace_id, group_id ORDER BY cycle)"""

BYTES = """bytes AS (SELECT trace_id, 2 * signal_id - 1 + half AS signal_id, signal_id AS storage_id, 8 * half AS bit_offset
  FROM layout, (SELECT unnest([0, 1]) AS half))"""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    event = "trace_id, signal_id, cycle, raw_bits, state"
    by = "PARTITION BY trace_id, signal_id ORDER BY cycle"

    # Changes and projections
    q["compact_changes"] = sql(
        [RAW, SMALL_RAW, "coarse AS (SELECT * REPLACE (cycle // 3600 AS cycle) FROM small_raw)", *compacted("c", "coarse")],
        "SELECT trace_id, signal_id AS storage_id, cycle, raw_bits, state FROM c")
    q["implicit_zero"] = sql([*SMALL, layout(2), """seeded AS (
  SELECT * FROM small_t UNION ALL
  SELECT trace_id, signal_id, 0, 0, CAST(0 AS TINYINT) FROM layout
  WHERE signal_id NOT IN (SELECT signal_id FROM small_t WHERE cycle = 0))""", no_repeats("z", "seeded")], "SELECT * FROM z")
    lives = f"""life AS (SELECT trace_id, signal_id, signal_id % 3 * 200000 AS since, signal_id % 4 AS initial FROM layout)"""
    q["implicit_start"] = sql([*SMALL, layout(2), lives, "begun AS (SELECT s.* FROM small_t s JOIN life USING (trace_id, signal_id) WHERE cycle >= since)", """seeded AS (
  SELECT trace_id, signal_id, cycle, raw_bits, state FROM begun UNION ALL
  SELECT trace_id, signal_id, since, initial, CAST(0 AS TINYINT) FROM life ANTI JOIN (SELECT signal_id, cycle AS since FROM begun) USING (signal_id, since))""",
                               no_repeats("z", "seeded")], "SELECT * FROM z")
    q["change_times"] = sql([RAW, SMALL_RAW, last_writes("w", "small_raw")],
                            f"SELECT trace_id, signal_id, cycle FROM w QUALIFY {changed('trace_id, signal_id')} "
                            f"AND lag(state) OVER ({by}) IS NOT NULL")
    seg = f"""seg AS (SELECT trace_id, signal_id, cycle AS s, least(coalesce(lead(cycle) OVER ({by}), tend), tend) AS e, raw_bits, state
  FROM small_t JOIN meta USING (trace_id))"""
    q["segments"] = sql([*SMALL, META, seg],
                        'SELECT trace_id, signal_id, s AS "start", e AS "end", raw_bits, state FROM seg WHERE e > s')
    q["segments_in_view"] = sql([*SMALL, META, seg], f"""SELECT * FROM (
  SELECT trace_id, signal_id, greatest(s, {LO}) AS "start", least(e, {HI}) AS "end", raw_bits, state FROM seg)
WHERE "end" > "start\"""")
    q["depth_limit"] = sql([NODES, TREE], "SELECT node_id, path FROM tree WHERE length(path) - length(replace(path, '.', '')) <= 2", True)
    q["bit_slice"] = sql([RAW, layout(16), BYTES], f"""SELECT r.trace_id, b.signal_id, r.cycle,
  CASE WHEN r.state = 0 THEN (r.raw_bits >> b.bit_offset) & 255 ELSE r.raw_bits END AS raw_bits, r.state
FROM raw r JOIN bytes b USING (storage_id)""")
    q["scale_cycles"] = sql([RAW], "SELECT trace_id, storage_id, cycle * 10 AS cycle, seq, raw_bits, state FROM raw")
    q["sanitize_no_z"] = sql([*SMALL, "clean AS (SELECT * REPLACE (CAST(0 AS TINYINT) AS state) FROM small_t)", no_repeats("c", "clean")],
                             "SELECT * FROM c")
    q["bool_storage"] = sql([RAW, SMALL_RAW, "b AS (SELECT * REPLACE (CAST(raw_bits <> 0 AS BIGINT) AS raw_bits) FROM small_raw)",
                             *compacted("c", "b")], "SELECT trace_id, signal_id AS storage_id, cycle, raw_bits, state FROM c")

    # Joins
    q["fan_out_aliases"] = sql([*FULL, layout(16), BYTES, """sliced AS (
  SELECT b.trace_id, b.signal_id, w.cycle, CASE WHEN w.state = 0 THEN (w.raw_bits >> b.bit_offset) & 255 ELSE w.raw_bits END AS raw_bits,
         w.state FROM full_t_w w JOIN bytes b ON w.signal_id = b.storage_id)""", no_repeats("c", "sliced")], "SELECT * FROM c")
    q["value_at"] = sql([*FULL, PROBES], """SELECT p.trace_id, p.signal_id, p.cycle, coalesce(t.raw_bits, 0) AS raw_bits,
  coalesce(t.state, CAST(2 AS TINYINT)) AS state
FROM (SELECT DISTINCT * FROM probes) p ASOF LEFT JOIN full_t t ON p.signal_id = t.signal_id AND p.cycle >= t.cycle""")
    q["common_signals"] = sql(DIFF[:len(RERUN) + 2], """SELECT 't' AS trace_id, 't' AS b_trace_id, l.path, l.signal_id AS a_signal_id, l.kind AS a_kind, l.width AS a_width,
  r.signal_id AS b_signal_id, r.kind AS b_kind, r.width AS b_width FROM layout l JOIN right_layout r USING (path)""")
    g = "trace_id, group_id"
    both = "\n  ".join(
        f"coalesce({held(f'b{i}', g)}, 0) AS bits_{i}, coalesce({held(f's{i}', g)}, CAST(2 AS TINYINT)) AS state_{i}," for i in (0, 1))
    gw = "OVER (PARTITION BY trace_id, group_id ORDER BY cycle)"
    q["merge_states"] = sql([*SMALL, layout(16), PAIRS, """merged AS (
  SELECT p.trace_id, p.group_id, t.cycle, max(CASE WHEN slot = 0 THEN raw_bits END) AS b0, max(CASE WHEN slot = 0 THEN state END) AS s0,
         max(CASE WHEN slot = 1 THEN raw_bits END) AS b1, max(CASE WHEN slot = 1 THEN state END) AS s1
  FROM small_t t JOIN pairs p USING (trace_id, signal_id) GROUP BY ALL)""",
                             f"filled AS (SELECT trace_id, group_id, cycle, {both.rstrip(',')} FROM merged)"],
                            f"""SELECT *, coalesce(lag(bits_0) {gw}, 0) AS prev_bits_0, coalesce(lag(state_0) {gw}, CAST(2 AS TINYINT)) AS prev_state_0,
  coalesce(lag(bits_1) {gw}, 0) AS prev_bits_1, coalesce(lag(state_1) {gw}, CAST(2 AS TINYINT)) AS prev_state_1 FROM filled""")
    early = "(SELECT signal_id FROM probes)"
    q["select_semi"] = sql([*FULL, PROBES], f"SELECT * FROM full_t WHERE signal_id IN {early}")
    q["tiles_for"] = sql([*FULL, PROBES, layout(16), tile_index("full_t", "layout")],
                         f"""SELECT trace_id, time_block, signal_chunk, records FROM idx
WHERE signal_chunk IN (SELECT (signal_id - 1) // {CHUNK} FROM probes)""")
    q["clip_regions"] = sql([*FULL, PROBES, META, f"""z AS (
  SELECT trace_id, signal_id, cycle AS s, e FROM (
    SELECT *, least(coalesce(lead(cycle) OVER ({by}), tend), tend) AS e FROM full_t JOIN meta USING (trace_id))
  WHERE state = 1 AND e > cycle)""", "days AS (SELECT DISTINCT cycle // 172800 * 172800 AS w FROM probes)"],
                            """SELECT trace_id, signal_id, w AS w_start, greatest(s, w) AS clip_start, least(e, w + 86400) AS clip_end
FROM z JOIN days ON s < w + 86400 AND e > w""")
    q["resolve_names"] = sql([layout(16), """doubled AS (
  SELECT signal_id, path FROM layout UNION ALL SELECT signal_id + 1000000, 'copy.' || name FROM layout WHERE signal_id % 10 = 0)""",
                              """asked AS (
  SELECT CASE i % 4 WHEN 0 THEN 'top.g' || (i % 8) || '.u' || i WHEN 1 THEN 'u' || i WHEN 2 THEN 'u' || i || '[15:0]'
           ELSE ' top.g' || (i % 8) || '.u' || i || ' [15:0] ' END AS name,
         CASE WHEN i % 4 IN (0, 3) THEN 'top.g' || (i % 8) || '.u' || i ELSE 'u' || i END AS key
  FROM (SELECT c_custkey + 1 AS i FROM customer))""",
                              "exact AS (SELECT path AS key, min(signal_id) AS id, count(DISTINCT signal_id) AS n FROM doubled GROUP BY 1)",
                              """leaf AS (SELECT regexp_extract(path, '[^.]*$') AS key, min(signal_id) AS id, count(DISTINCT signal_id) AS n
  FROM doubled GROUP BY 1)"""],
                             """SELECT 't' AS trace_id, name, CASE WHEN e.n = 1 THEN e.id WHEN e.n IS NULL AND l.n = 1 THEN l.id END AS signal_id,
  CASE WHEN e.n > 1 THEN 'ambiguous' WHEN e.n = 1 THEN 'exact' WHEN l.n > 1 THEN 'ambiguous' WHEN l.n = 1 THEN 'leaf' ELSE 'unknown' END AS status
FROM asked LEFT JOIN exact e USING (key) LEFT JOIN leaf l USING (key)""")

    # Search
    q["find_value"] = sql([*SMALL, layout(2), hits("layout", "2")], "SELECT * FROM hits")
    q["find_negative_value"] = sql([*SMALL, layout(2), hits("layout", "3")], "SELECT * FROM hits")
    q["value_find_summary"] = sql(SUMMARY, "SELECT * FROM summary")
    q["value_find_totals"] = sql(SUMMARY, """SELECT CAST(sum(hits) AS BIGINT) AS total_hits, count(*) FILTER (hits > 0) AS matched_signals,
  count(*) FILTER (width_skipped) AS skipped_signals,
  (SELECT cycle FROM hits ORDER BY cycle, signal_id LIMIT 1) AS first_cycle,
  (SELECT signal_id FROM hits ORDER BY cycle, signal_id LIMIT 1) AS first_signal_id FROM summary""")
    q["next_change"] = sql([*SMALL, MARKS, PROBES], neighbour("marks", "ASOF", "<"))
    q["prev_change"] = sql([*SMALL, MARKS, PROBES], neighbour("marks", "ASOF", ">"))
    q["ordered_hits"] = q["find_value"] + "\nORDER BY cycle, signal_id, sample_index"
    q["ordered_events"] = sql(FULL, "SELECT * FROM full_t ORDER BY cycle, signal_id")
    q["head_per_signal"] = sql(FULL, f"""SELECT *, CAST(row_number() OVER ({by}) AS INTEGER) AS rank FROM full_t
WHERE signal_id IN (SELECT CAST(user_id + 1 AS BIGINT) AS i FROM events GROUP BY i ORDER BY i LIMIT 6)
QUALIFY row_number() OVER ({by}) <= 12""")
    q["union_times"] = sql(FULL, "SELECT DISTINCT trace_id, cycle FROM full_t ORDER BY cycle")

    # Compare
    q["diff_traces"] = sql(DIFF, "SELECT 't' AS trace_id, * FROM regions")
    q["diff_summary"] = sql(DIFF, """SELECT 't' AS trace_id, path, count(*) AS regions, CAST(sum("end" - "start") AS BIGINT) AS differing_cycles,
  min("start") AS first_cycle, max("end") AS last_cycle FROM regions GROUP BY path""")
    starts = 'starts AS (SELECT "start" AS cycle FROM regions)'
    q["next_diff"] = sql([*DIFF, PROBES, starts], neighbour("starts", "ASOF", "<"))
    q["prev_diff"] = sql([*DIFF, PROBES, starts], neighbour("starts", "ASOF", ">="))
    q["compared_signals"] = sql(COMPARED, "SELECT 't' AS trace_id, 't' AS source_trace, * FROM compared")
    q["compared_trace"] = sql(COMPARED, """SELECT 't' AS trace_id, c.signal_id, c.side_path AS path, t.cycle, t.raw_bits, t.state
FROM compared c JOIN small_t t ON t.signal_id = c.source_id WHERE c.side = 'a'
UNION ALL SELECT 't', c.signal_id, c.side_path, t.cycle, t.raw_bits, t.state
FROM compared c JOIN rerun_t t ON t.signal_id = c.source_id WHERE c.side = 'b'""")
    q["compared_meta"] = sql(DIFF, """SELECT 't' AS trace_id, 'Compare_events_vs_rerun' AS title, '1s' AS timescale, CAST(0 AS BIGINT) AS "start", a_end AS "end",
  (SELECT count(*) FROM both_sides) AS common_paths, (SELECT count(DISTINCT path) FROM regions) AS differing_paths, 'ok' AS status FROM ends""")

    # Overviews
    q["lod_pyramid"] = sql([*FULL, pyramid()], "SELECT * FROM pyramid")
    q["select_lod_levels"] = sql([*FULL, pyramid(base=1024), *kept_levels(40)], "\nUNION ALL ".join(
        f"SELECT trace_id, signal_id, {k} AS level, bucket, n AS records, source AS source_records FROM step_{k + 1} WHERE kept"
        for k in range(7)))
    order = "(raw_bits::HUGEINT + CASE WHEN raw_bits < 0 THEN 18446744073709551616 ELSE 0 END)"
    q["lod_buckets"] = sql(WIDE, f"""SELECT trace_id, signal_id, "start", "start" + 32000 AS "end", first_bits, last_bits,
  coalesce(min_bits, 0) AS min_bits, coalesce(max_bits, 0) AS max_bits, transitions, state_mask FROM (
  SELECT trace_id, signal_id, cycle // 32000 * 32000 AS "start", arg_min(raw_bits, cycle) AS first_bits, arg_max(raw_bits, cycle) AS last_bits,
         arg_min(raw_bits, {order}) FILTER (state = 0) AS min_bits, arg_max(raw_bits, {order}) FILTER (state = 0) AS max_bits,
         count(*) AS transitions, CAST(bit_or({mask_sql()}) AS INTEGER) AS state_mask FROM wide_t GROUP BY trace_id, signal_id, "start")""")
    q["viewport_raster"] = sql([*FLAG, *raster("flag_t", 0, "tend", 1000)], RASTER_BODY)
    q["viewport_raster_zoomed"] = sql([*SMALL, *raster("small_t", LO, HI, 500)], RASTER_BODY)
    q["lod_ranges"] = sql([*FULL, pyramid(), *RANGES], "SELECT * FROM ranges")
    width, span = 200, "(SELECT tend FROM meta)"
    q["overview_rows"] = sql([*FULL, META, pyramid(), *RANGES, f"""chosen AS MATERIALIZED (
  SELECT trace_id, signal_id, coalesce(max(level) FILTER (bucket <= ceil({span} / {max(64, width // 2)}.0)), min(level)) AS level
  FROM ranges WHERE "end" > 0 AND "start" < {span} GROUP BY ALL)"""], f"""SELECT trace_id, signal_id, level, cycle, raw_bits, state
FROM pyramid JOIN chosen USING (trace_id, signal_id, level) WHERE cycle < {span}
UNION ALL SELECT trace_id, signal_id, -1, cycle, raw_bits, state FROM full_t ANTI JOIN chosen USING (trace_id, signal_id) WHERE cycle < {span}""")
    q["overview_rows_raw"] = sql(FULL, f"SELECT trace_id, signal_id, -1 AS level, cycle, raw_bits, state FROM full_t WHERE cycle >= {LO} AND cycle < {HI}")
    coarse = "coarse AS MATERIALIZED (SELECT * FROM pyramid WHERE level >= 4)"
    q["overview_rows_finest"] = sql([*FULL, pyramid(), coarse, *[part.replace("FROM pyramid", "FROM coarse") for part in RANGES], """chosen AS MATERIALIZED (
  SELECT trace_id, signal_id, coalesce(max(level) FILTER (bucket <= 4000), min(level)) AS level
  FROM ranges WHERE "end" > 0 AND "start" < 2000000 GROUP BY ALL)"""], """SELECT trace_id, signal_id, level, cycle, raw_bits, state
FROM coarse JOIN chosen USING (trace_id, signal_id, level) WHERE cycle < 2000000
UNION ALL SELECT trace_id, signal_id, -1, cycle, raw_bits, state FROM full_t ANTI JOIN chosen USING (trace_id, signal_id) WHERE cycle < 2000000""")
    budget, cycles, source = [*FULL, f"""r AS MATERIALIZED (
  SELECT *, lag(cycle) OVER w AS p_cycle, lag(raw_bits) OVER w AS p_bits, lag(state) OVER w AS p_state, row_number() OVER w AS source, lead(cycle) OVER w IS NULL AS is_last
  FROM full_t WHERE cycle >= 0 WINDOW w AS ({by}))"""], 8192, "r"
    kept = []
    for k in range(7):
        budget.append(f"""closed_{k} AS (SELECT * EXCLUDE (source), source, row_number() OVER ({by}) AS n FROM {source}
  WHERE p_cycle IS NOT NULL AND cycle // {cycles} <> p_cycle // {cycles})""")
        budget.append(f"""held_{k} AS (SELECT *, n - greatest(0, max(n - source // 5) OVER ({by})) AS held FROM closed_{k})""")
        budget.append(f"""event_{k} AS MATERIALIZED (SELECT trace_id, signal_id, cycle, p_cycle, p_bits, p_state, held + 1 AS source,
  held > coalesce(lag(held) OVER ({by}), 0) AS accepted FROM held_{k})""")
        kept.append(f"""SELECT trace_id, signal_id, {k} AS level, {cycles}::BIGINT AS bucket, p_cycle // {cycles} * {cycles} AS window_start, p_cycle AS cycle, p_bits AS raw_bits, p_state AS state
FROM event_{k} WHERE accepted
UNION ALL SELECT trace_id, signal_id, {k}, {cycles}::BIGINT, cycle // {cycles} * {cycles}, cycle, raw_bits, state FROM r WHERE is_last""")
        source, cycles = f"event_{k}", cycles * 5
    q["budgeted_pyramid"] = sql(budget, "\nUNION ALL ".join(kept))

    def hopped(trace: str, place: str, target: str) -> str:
        """Chains by recursion: the next sample at least 50,000 cycles later, ``target`` of those of either parity."""
        near = " ".join(f"ASOF LEFT JOIN (SELECT signal_id, cycle AS c{i} FROM i WHERE {place.format(i)}) b{i} ON b{i}.signal_id = a.signal_id AND b{i}.c{i} >= a.cycle + 50000"
                        for i in (0, 1))
        return sql([*trace, f"""i AS MATERIALIZED (
  SELECT *, row_number() OVER w - 1 AS place, lag(cycle) OVER w AS before, lead(cycle) OVER w AS after FROM {"full_t" if trace is FULL else "flag_t"}
  WHERE cycle BETWEEN 86400 AND 2000000 WINDOW w AS ({by}))""", f"jumps AS MATERIALIZED (SELECT a.signal_id, a.cycle, {target} AS goal FROM i a {near})",
                    """chain AS (SELECT signal_id, min(cycle) AS cycle FROM i GROUP BY ALL
  UNION ALL SELECT j.signal_id, j.goal FROM chain c JOIN jumps j ON j.signal_id = c.signal_id AND j.cycle = c.cycle WHERE goal IS NOT NULL)""",
                    """wanted AS (SELECT signal_id, cycle FROM chain UNION SELECT i.signal_id, i.before FROM i JOIN chain USING (signal_id, cycle)
  UNION SELECT signal_id, cycle FROM i WHERE after IS NULL)"""],
                   f"""SELECT trace_id, signal_id, cycle, raw_bits, state FROM i JOIN wanted USING (signal_id, cycle)
UNION ALL SELECT trace_id, signal_id, max(cycle), arg_max(raw_bits, cycle), arg_max(state, cycle) FROM {"full_t" if trace is FULL else "flag_t"}
WHERE cycle < 86400 GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1)

    q["hops"] = hopped(FULL, "TRUE", "c0")
    q["hops_alternating"] = hopped(FLAG, "place % 2 = {}", "CASE WHEN a.place % 2 = 0 THEN c1 ELSE c0 END")
    t0, t1, target = 86_400, 2_000_000, 20
    q["downsample"] = sql([*FULL, f"""carry AS (
  SELECT trace_id, signal_id, max(cycle) AS cycle, arg_max(raw_bits, cycle) AS raw_bits, arg_max(state, cycle) AS state
  FROM full_t WHERE cycle < {t0} GROUP BY ALL)""", f"inside AS (SELECT * FROM full_t WHERE cycle BETWEEN {t0} AND {t1})",
                           f"""ranked AS (
  SELECT i.*, row_number() OVER (PARTITION BY i.signal_id, (i.cycle - {t0}) // {(t1 - t0) // target} ORDER BY i.cycle) AS up,
         row_number() OVER (PARTITION BY i.signal_id, (i.cycle - {t0}) // {(t1 - t0) // target} ORDER BY i.cycle DESC) AS down
  FROM inside i)"""],
                          f"SELECT {event} FROM carry UNION ALL SELECT {event} FROM ranked WHERE up = 1 OR down = 1")
    pct = "round(CASE WHEN {1} = 0 THEN 0.0 ELSE 100.0::DOUBLE * {0} / {1} END, 6)"
    columns = ["tiles", "active_records", "slots", "change_times", "transitions"]
    shares = ", ".join(f"{pct.format(c, f'sum({c}) OVER ()')} AS {c}_pct" for c in columns)
    q["tile_report"] = sql([*RERUN, layout(2), "both_t AS (SELECT * FROM small_t UNION ALL SELECT * REPLACE ('rerun' AS trace_id) FROM rerun_t)",
                            "both_l AS (SELECT * FROM layout UNION ALL SELECT * REPLACE ('rerun' AS trace_id) FROM layout)",
                            tile_index("both_t", "both_l"), """per AS (
  SELECT trace_id, count(*) AS tiles, CAST(sum(active_signals) AS BIGINT) AS active_records, CAST(sum(signal_count) AS BIGINT) AS slots,
         CAST(sum(change_times) AS BIGINT) AS change_times, CAST(sum(records) AS BIGINT) AS transitions FROM idx GROUP BY ALL)"""],
                           f"SELECT *, {pct.format('active_records', 'slots')} AS active_slot_pct, {shares} FROM per")

    # Sources
    q["read_json_trace"] = sql(DOCS, """SELECT trace_id, CAST(1 AS BIGINT) AS signal_id, cycle, seq,
  CASE WHEN state = 1 THEN 0 WHEN form = 2 THEN 1 WHEN form = 3 THEN 0 ELSE raw_bits END AS raw_bits, state FROM items WHERE NOT bad_time""")
    q["read_json_trace_errors"] = sql(DOCS, """SELECT trace_id, CAST(1 AS BIGINT) AS signal_id, seq, 'time_not_text' AS rule
FROM items WHERE bad_time""")
    q["trace_extents"] = sql(DOCS, """SELECT trace_id, trace_id AS title, '1s' AS timescale,
  CAST(CASE WHEN day % 2 <> 0 THEN 5 WHEN hi > lo THEN lo ELSE 0 END AS BIGINT) AS "start",
  CAST(CASE WHEN day % 2 <> 0 THEN 2592000 WHEN hi > lo THEN hi ELSE 100 END AS BIGINT) AS "end"
FROM (SELECT trace_id, day, min(cycle) FILTER (NOT bad_time) AS lo, max(cycle) FILTER (NOT bad_time) AS hi FROM items GROUP BY ALL)""")
    q["write_json_trace"] = sql(FULL, """SELECT trace_id, 'u' || signal_id AS name, 'bus' AS kind, 16 AS width, 'hex' AS radix,
  CAST(cycle AS VARCHAR) AS time, CASE WHEN state = 1 THEN 'Z' ELSE '0x' || lpad(hex(raw_bits), 4, '0') END AS text FROM full_t""")
    q["json_round_trip"] = sql(FULL, f"SELECT {event} FROM full_t")
    q["write_tiled"] = sql(FULL, f"SELECT * FROM {tiled('full_t')}")
    q["tile_index"] = sql([*FULL, layout(16), tile_index("full_t", "layout")], "SELECT * EXCLUDE (change_times) FROM idx")
    q["load_signals"] = sql(FULL, f"SELECT * FROM full_t WHERE signal_id IN (3, 5, 8, 40, 41, 77) AND cycle BETWEEN {LO} AND {HI}")
    q["load_selected"] = sql([*FULL, PROBES], f"SELECT * FROM full_t WHERE signal_id IN {early} AND cycle BETWEEN {LO} AND {HI}")
    q["load_window_carry_in"] = sql(FULL, f"""SELECT {event} FROM full_t WHERE cycle > {LO} AND cycle <= {HI}
UNION ALL SELECT trace_id, signal_id, {LO}, arg_max(raw_bits, cycle), arg_max(state, cycle) FROM full_t WHERE cycle <= {LO} GROUP BY 1, 2""")
    q["signal_catalogue"] = sql([*FULL, layout(16)], """SELECT l.trace_id, l.signal_id, path, kind, width, 'hex' AS radix, coalesce(n, 0) AS events
FROM layout l LEFT JOIN (SELECT signal_id, count(*) AS n FROM full_t GROUP BY 1) USING (signal_id)""")
    q["synthetic_clock"] = sql([RAW, META, """c AS (
  SELECT CAST(n_nationkey + 9001 AS BIGINT) AS signal_id, n_nationkey % 2 AS first, CAST(n_nationkey * 3600 + 1800 AS BIGINT) AS p FROM nation)"""],
                               """SELECT 't' AS trace_id, signal_id, k * p AS cycle, CAST((first + k) % 2 AS BIGINT) AS raw_bits, CAST(0 AS TINYINT) AS state
FROM (SELECT *, unnest(range(0, least(tend, 2000000) // p + 1)) AS k FROM c, meta)""")
    q["value_at_tiles"] = q["value_at"]
    q["block_entries"] = sql([*FULL, f"blocks AS (SELECT unnest(range(0, max(cycle) // {SPAN} + 2)) AS time_block FROM full_t)",
                              "ids AS (SELECT DISTINCT trace_id, signal_id FROM full_t)"], f"""SELECT i.trace_id, i.signal_id, time_block::BIGINT AS time_block,
  (i.signal_id - 1) // {CHUNK} AS signal_chunk, raw_bits, state
FROM blocks CROSS JOIN ids i ASOF JOIN full_t f ON f.trace_id = i.trace_id AND f.signal_id = i.signal_id AND f.cycle < time_block * {SPAN}""")
    q["block_snapshots"] = sql([*FULL, f"""e AS (
  SELECT trace_id, signal_id, cycle // {SPAN} AS time_block, max(cycle) AS last_cycle, arg_max(raw_bits, cycle) AS last_bits,
         arg_max(state, cycle) AS last_state FROM full_t GROUP BY ALL)"""], """SELECT *,
  lag(last_bits) OVER (PARTITION BY trace_id, signal_id ORDER BY time_block) AS entry_bits,
  lag(last_state) OVER (PARTITION BY trace_id, signal_id ORDER BY time_block) AS entry_state FROM e""")

    # Functions
    number = """CASE WHEN regexp_matches(v, '^0[xX]') THEN try_cast('0x' || regexp_extract(v, '^0[xX]([0-9a-fA-F]+)$', 1) AS UBIGINT)
    WHEN regexp_matches(v, '^0[bB]') THEN try_cast('0b' || regexp_extract(v, '^0[bB]([01]+)$', 1) AS UBIGINT)
    WHEN regexp_matches(v, '^[0-9]+$') THEN try_cast(v AS UBIGINT)
    ELSE try_cast('0x' || regexp_extract(v, '^([0-9a-fA-F]+)$', 1) AS UBIGINT) END"""
    mask = "CASE WHEN width = 64 THEN 18446744073709551615::UBIGINT ELSE 4095::UBIGINT END"
    q["normalize_text"] = sql([*TEXTS, f"parsed AS (SELECT *, (coalesce({number}, 0::UBIGINT) & {mask})::HUGEINT AS u FROM (SELECT *, trim(value) AS v FROM texts))"],
                              f"""SELECT seq, kind, width, value,
  CASE WHEN v IN ('Z', '__ABSENT__') THEN 0 WHEN kind = 'bit' THEN CAST(v = '1' AS BIGINT) ELSE {to_signed('u')} END AS raw_bits,
  CAST(CASE v WHEN 'Z' THEN 1 WHEN '__ABSENT__' THEN 2 ELSE 0 END AS TINYINT) AS state FROM parsed""")
    q["format_text"] = sql(RADIX, f"""SELECT trace_id, signal_id, cycle, CASE WHEN state = 1 THEN 'Z'
  WHEN radix = 'bin' THEN lpad(bin(u::UBIGINT), width, '0') WHEN radix = 'hex' THEN lpad(hex(u::UBIGINT), CAST(ceil(width / 4.0) AS INTEGER), '0')
  WHEN radix = 'int' AND width = 32 THEN CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS VARCHAR)
  WHEN radix = 'int' AND width = 64 THEN CAST({to_signed('u')} AS VARCHAR)
  WHEN radix IN ('int64', 'uint64') AND width <> 64 THEN 'N/A' WHEN radix = 'int64' THEN CAST({to_signed('u')} AS VARCHAR)
  ELSE CAST(u AS VARCHAR) END AS text FROM shown""")
    q["format_floats"] = sql([*WIDE, """parts AS (
  SELECT trace_id, signal_id, cycle, state, raw_bits & 4294967295 AS u, (raw_bits & 4294967295) >> 31 AS neg,
         ((raw_bits >> 23) & 255) AS e, (raw_bits & 8388607) AS m FROM wide_t)""", """floats AS (
  SELECT *, (CASE WHEN neg = 1 THEN -1 ELSE 1 END) * CASE WHEN e = 0 THEN m * pow(2.0, -149) ELSE (8388608 + m) * pow(2.0, e - 150) END AS f
  FROM parts)""", """texts AS (
  SELECT *, CASE WHEN e = 255 THEN CASE WHEN m <> 0 THEN 'nan' WHEN neg = 1 THEN '-inf' ELSE 'inf' END ELSE printf('%.8g', f) END AS t
  FROM floats)"""], """SELECT trace_id, signal_id, cycle, CASE WHEN state = 1 THEN 'Z' WHEN contains(t, 'n') OR contains(split_part(t, 'e', 1), '.') THEN t
  WHEN contains(t, 'e') THEN split_part(t, 'e', 1) || '.0e' || split_part(t, 'e', 2) ELSE t || '.0' END AS text FROM texts""")
    q["name_forms"] = sql([layout(16), """forms AS (
  SELECT trace_id, signal_id AS i, CASE i % 9 WHEN 0 THEN '' WHEN 1 THEN path || '.' WHEN 2 THEN name ELSE path END AS path,
         CASE WHEN i % 4 = 0 THEN 1 ELSE width END AS width FROM layout)""", """named_forms AS (
  SELECT *, CASE WHEN path = '' THEN 'sig_' || i ELSE path END AS display_name FROM forms)"""], """SELECT trace_id, i AS signal_id, display_name,
  CASE WHEN width <= 1 THEN display_name ELSE display_name || '[' || (width - 1) || ':0]' END AS ranged_name, display_name AS bare_name,
  CASE WHEN path = '' THEN 'root' WHEN path LIKE '%.' THEN 'unnamed' ELSE regexp_extract(path, '[^.]*$') END AS leaf,
  CASE WHEN contains(display_name, '.') THEN regexp_replace(display_name, '^(.*\\.)([^.]*)$', '\\1A \\2') ELSE 'A ' || display_name END AS a_path,
  CASE WHEN contains(display_name, '.') THEN regexp_replace(display_name, '^(.*\\.)([^.]*)$', '\\1B \\2') ELSE 'B ' || display_name END AS b_path,
  'node_' || (i + 999) AS default_node_name FROM named_forms""")
    q["classify"] = sql([layout(16), """kinds AS (
  SELECT trace_id, signal_id, ['Bool','SignedInt','UnsignedInt','Float64','Enum'][signal_id % 5 + 1] AS k,
         [1, 8, 12, 32, 33, 64][(signal_id // 5) % 6 + 1] AS w, [NULL, 'auto', 'hex'][signal_id % 3 + 1] AS r FROM layout)""",
                         """typed AS (
  SELECT *, CASE WHEN k = 'Bool' THEN 'Bool' WHEN k = 'Float64' THEN CASE WHEN w <= 32 THEN 'F32' ELSE 'F64' END
         ELSE CASE WHEN k = 'SignedInt' THEN 'I' ELSE 'U' END || CASE WHEN w <= 8 THEN '8' WHEN w <= 16 THEN '16' WHEN w <= 32 THEN '32' ELSE '64' END
         END AS value_type,
         coalesce(r, CASE k WHEN 'Bool' THEN 'bin' WHEN 'SignedInt' THEN 'dec' WHEN 'Float64' THEN 'float' ELSE 'hex' END) AS radix FROM kinds)"""],
                        """SELECT trace_id, signal_id, value_type, CASE WHEN value_type = 'Bool' OR w = 1 THEN 'bit' ELSE 'bus' END AS kind, radix,
  CASE WHEN radix IN ('bin', 'dec', 'hex') THEN radix
       WHEN radix = 'float' THEN CASE WHEN w = 64 OR value_type = 'F64' THEN 'double' ELSE 'float' END
       WHEN value_type = 'F32' THEN 'float' WHEN value_type = 'F64' THEN 'double' WHEN value_type = 'I64' THEN 'int64'
       WHEN value_type = 'U64' THEN 'uint64' WHEN value_type LIKE 'I%' THEN 'int' WHEN value_type LIKE 'U%' THEN 'uint' ELSE 'bin' END AS display_radix
FROM typed""")

    # Hierarchy
    q["node_paths"] = sql([NODES, TREE], "SELECT 't' AS trace_id, node_id, path, depth, array_to_string(anc, '/') AS ancestors FROM tree", True)
    q["tree_from_names"] = sql([layout(16), """parts AS (SELECT path, string_split(path, '.') AS p, signal_id, width FROM layout)""",
                                """prefixes AS (SELECT DISTINCT array_to_string(p[1:n], '.') AS path, array_to_string(p[1:n-1], '.') AS parent, p[n] AS name,
  n - 1 AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM parts))""",
                                "numbered AS (SELECT *, row_number() OVER (ORDER BY path) AS id FROM prefixes)"],
                               """SELECT 't' AS trace_id, n.id AS node_id, coalesce(u.id, 0) AS parent_id, n.name, n.path, CAST(n.depth AS INTEGER) AS depth,
  l.signal_id, l.width FROM numbered n LEFT JOIN numbered u ON u.path = n.parent LEFT JOIN layout l ON l.path = n.path""")
    found = "SELECT 't' AS trace_id, node_id AS start_id, node_id FROM named WHERE contains(lower(shown), '{}') ORDER BY node_id"
    q["search_name"] = sql([NODES, NAMED], found.format("nation_2"))
    q["search_range"] = sql([NODES, NAMED], found.format("[15:0]"))
    q["search_chain"] = sql([NODES, NAMED], """SELECT 't' AS trace_id, a.node_id AS start_id, b.node_id FROM named a JOIN named b ON b.parent_id = a.node_id
WHERE lower(a.name) = 'america' AND lower(b.name) = 'nation_21'""")
    q["search_chain_all"] = sql([NODES, NAMED], """SELECT 't' AS trace_id, t.node_id AS start_id, b.node_id FROM named t
JOIN named a ON a.parent_id = t.node_id JOIN named b ON b.parent_id = a.node_id
WHERE lower(t.name) = 'top' AND lower(a.name) = 'america' AND lower(b.name) = 'nation_21'""")
    q["search_visibility"] = sql([NODES, TREE, NAMED, SEARCHED, CLOSURE], """SELECT DISTINCT 't' AS trace_id, node_id FROM (
  SELECT root AS node_id FROM closure WHERE node_id IN (SELECT node_id FROM searched)
  UNION ALL SELECT node_id FROM closure WHERE root IN (SELECT s.node_id FROM searched s JOIN nodes n USING (node_id) WHERE n.node_kind <> 'SignalLeaf'))""", True)
    q["signals_under"] = sql([NODES, TREE, NAMED, SEARCHED, CLOSURE], """SELECT 't' AS trace_id, node_id - 999 AS signal_id, path FROM tree
WHERE node_kind = 'SignalLeaf' AND node_id IN (SELECT node_id FROM closure WHERE root IN (SELECT node_id FROM searched))""", True)
    q["leaf_distribution"] = sql([NODES, TREE, CLOSURE, """counted AS (
  SELECT root AS node_id, count(*) AS leaf_count FROM closure WHERE node_kind = 'SignalLeaf' GROUP BY root)"""],
                                 """SELECT 't' AS trace_id, node_id, leaf_count, depth, path,
  CAST(row_number() OVER (PARTITION BY depth ORDER BY leaf_count DESC, node_id) AS INTEGER) AS rank
FROM counted JOIN tree USING (node_id) QUALIFY row_number() OVER (PARTITION BY depth ORDER BY leaf_count DESC, node_id) <= 50""", True)
    q["leaf_counts"] = sql([NODES, TREE, CLOSURE, """counted AS (
  SELECT root AS node_id, count(*) AS leaf_count FROM closure WHERE node_kind = 'SignalLeaf' GROUP BY root)"""],
                           "SELECT 't' AS trace_id, node_id, leaf_count, depth, path FROM counted JOIN tree USING (node_id)", True)
    q["leaf_totals"] = sql([NODES, TREE, CLOSURE], """SELECT 't' AS trace_id, count(*) AS leaves_at_roots, max(depth) AS max_depth,
  (SELECT count(DISTINCT root) FROM closure WHERE node_kind = 'SignalLeaf') AS active_nodes FROM tree WHERE node_kind = 'SignalLeaf'""", True)
    q["check_topology"] = sql(BROKEN, TOPOLOGY, True)
    q["check_updates"] = sql([*UPDATES, layout(16)], """SELECT trace_id, storage_id, cycle, seq, rule FROM (
  SELECT *, 'cycle_negative' AS rule FROM odd WHERE cycle < 0
  UNION ALL SELECT *, 'signal_undefined' FROM odd WHERE storage_id NOT IN (SELECT signal_id FROM layout)
  UNION ALL SELECT *, 'signal_is_clock' FROM odd WHERE storage_id IN (SELECT signal_id FROM layout) AND storage_id % 41 = 0
  UNION ALL SELECT *, 'state_not_known' FROM odd WHERE state <> 0
  UNION ALL SELECT *, 'value_too_wide' FROM odd WHERE storage_id IN (SELECT signal_id FROM layout) AND state = 0 AND raw_bits > 65535)
UNION ALL SELECT trace_id, storage_id, cycle, max(seq), 'duplicate_in_cycle' FROM odd GROUP BY 1, 2, 3 HAVING count(*) > 1""")
    q["check_submission_order"] = sql(UPDATES, """SELECT trace_id, seq, cycle, 'cycle_not_increasing' AS rule FROM odd
QUALIFY cycle < max(cycle) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

    # Periodic and derived signals
    q["detect_periodic"] = sql(periodic(0), PERIODIC_BODY)
    q["detect_periodic_tolerant"] = sql(periodic(1), PERIODIC_BODY)
    q["detect_stride"] = sql([*CLOCKISH, "g AS (SELECT *, cycle - lag(cycle) OVER (PARTITION BY signal_id ORDER BY cycle) AS gap FROM ticks)"],
                             """SELECT 't' AS trace_id, signal_id, count(*) AS events, min(cycle) AS first_cycle, min(gap) AS stride
FROM g GROUP BY signal_id HAVING count(*) >= 6 AND min(gap) = max(gap)""")
    narrow = ("CASE WHEN b % 8 <> 0 THEN xor((((a + b) % 65536) * 2) % 65536, a % (b % 8))::HUGEINT | (CASE WHEN a < b THEN 1 ELSE 0 END)::HUGEINT END")
    q["derive_signal"] = sql([*FULL, *derived("full_t", narrow)], DERIVED_BODY)
    two64 = "18446744073709551616::HUGEINT"
    # 0xFFFFFFFFFFFFFFC5 is -59 modulo 2^64.
    product = f"((({two64} * 59 - 59 * a) + b) % {two64})"
    wide = f"CASE WHEN a <> 0 THEN (({product} // 3) - (({two64} - 1 - b) % a) + {two64}) % {two64} END"
    q["derive_wide_signal"] = sql([*WIDE, *derived("wide_t", wide)], DERIVED_BODY)

    # Streaming
    q["stream_changes"] = sql(SMALL, f"""SELECT trace_id, signal_id AS storage_id, cycle, raw_bits, state FROM small_t
QUALIFY NOT (lag(state) OVER ({by}) IS NULL AND state = 0 AND raw_bits = 0)""")
    q["stream_ingest_guard"] = sql([RAW, layout(16), f"""arrived AS (
  SELECT trace_id, cycle, seq, state, least(cycle // 648000 + CASE WHEN seq % 100 = 0 THEN 1 ELSE 0 END, 3) AS batch,
         CASE WHEN seq % 83 = 0 THEN storage_id + 7000000 ELSE storage_id END AS storage_id,
         CASE WHEN seq % 79 = 0 THEN raw_bits + 65536 ELSE raw_bits END AS raw_bits FROM raw)""", """ruled AS (
  SELECT a.*, CASE WHEN l.signal_id IS NULL THEN 'signal_undefined' WHEN a.storage_id % 41 = 0 THEN 'signal_is_clock'
              WHEN a.state = 0 AND a.raw_bits > 65535 THEN 'value_too_wide' END AS rule
  FROM arrived a LEFT JOIN layout l ON l.signal_id = a.storage_id)""", """timely AS (
  SELECT r.*, (SELECT max(p.cycle) FROM ruled p WHERE p.storage_id = r.storage_id AND p.rule IS NULL AND p.batch < r.batch) AS last
  FROM ruled r)"""], """SELECT trace_id, storage_id, cycle, seq, coalesce(rule, 'late') AS reason FROM timely
WHERE rule IS NOT NULL OR cycle <= last""")
    q["stream_tiles"] = sql(SMALL, f"""SELECT * FROM {tiled('small_t')}""")
    q["stream_tiles_rewritten"] = q["stream_tiles"]
    q["stream_lod"] = sql(SMALL, """SELECT trace_id, signal_id, cycle // 32000 * 32000 AS window_start, max(cycle) AS cycle,
  arg_max(raw_bits, cycle) AS raw_bits, arg_max(state, cycle) AS state FROM small_t GROUP BY ALL""")
    q["stream_lod_levels"] = sql(SMALL, """SELECT trace_id, signal_id, level::INTEGER AS level, bucket, cycle // bucket * bucket AS window_start, max(cycle) AS cycle,
  arg_max(raw_bits, cycle) AS raw_bits, arg_max(state, cycle) AS state
FROM small_t, (SELECT level, (256 * 5 ** level)::BIGINT AS bucket FROM range(7) l(level)) GROUP BY ALL""")
    q["stream_lifecycle"] = sql([RAW, layout(2), """life AS (
  SELECT trace_id, signal_id, signal_id % 3 * 200000 AS since, signal_id % 4 AS initial, CASE WHEN signal_id % 4 = 1 THEN 1500000 + signal_id END AS until FROM layout)""",
                                 """happened AS (
  SELECT l.trace_id, l.signal_id, r.cycle, r.seq, CASE WHEN r.state = 0 THEN r.raw_bits % 4 ELSE r.raw_bits END AS raw_bits, r.state
  FROM raw r JOIN life l ON l.signal_id = r.storage_id WHERE r.cycle >= since AND (until IS NULL OR r.cycle <= until)
  UNION ALL SELECT trace_id, signal_id, since, -1, initial, 0 FROM life
  UNION ALL SELECT trace_id, signal_id, until, 9223372036854775807, 0, 1 FROM life WHERE until IS NOT NULL)""",
                                 """written AS (
  SELECT trace_id, signal_id, cycle, arg_max(raw_bits, seq) AS raw_bits, arg_max(state, seq) AS state FROM happened GROUP BY ALL)"""],
                                f"""SELECT trace_id, signal_id AS storage_id, cycle, raw_bits, state::TINYINT AS state FROM written
QUALIFY lag(state) OVER ({by}) IS NULL OR lag(state) OVER ({by}) <> state OR lag(raw_bits) OVER ({by}) <> raw_bits""")
    return q
