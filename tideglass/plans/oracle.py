"""The same queries as SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from tideglass.plans.queries import (
    EVENT_COLUMNS,
    EVENT_ID,
    EVENT_SORT_CURSOR,
    SCALES,
    SORT_SIZE,
    USER,
    WINDOW_ID,
    WINDOW_SORT_CURSOR,
)

_EVENTS = """
ev AS (
    SELECT
        event_id,
        ts - to_seconds((event_id * 7919) % 864000) AS occurred_at,
        CASE event_type WHEN 'signup' THEN 'key_press' WHEN 'purchase' THEN 'key_release'
            WHEN 'click' THEN 'button_press' WHEN 'error' THEN 'button_release'
            WHEN 'view' THEN 'wheel' END AS event_kind,
        CASE WHEN event_type <> 'view' THEN 'Key' || CAST(event_id % 26 AS VARCHAR)
            WHEN event_id % 2 = 0 THEN '' ELSE 'delta_x:0, delta_y:1' END AS event_value,
        CASE WHEN event_type = 'view' THEN CAST(0 AS DOUBLE) END AS delta_x,
        CASE WHEN event_type = 'view' THEN CAST(1 AS DOUBLE) END AS delta_y,
        props AS raw_event,
        CAST(NULL AS VARCHAR) AS raw_window,
        'listener' AS collector_name,
        'unknown' AS collector_version,
        user_id % 10 <> 0 AS has_window,
        CASE WHEN user_id % 10 <> 0 THEN 'App ' || CAST(user_id % 12 AS VARCHAR) END AS app_name,
        CASE WHEN user_id % 10 <> 0 THEN user_id END AS process_id,
        CASE WHEN user_id % 10 <> 0 AND user_id % 3 <> 0
            THEN '/opt/app' || CAST(user_id % 12 AS VARCHAR) END AS process_path,
        CASE WHEN user_id % 10 <> 0 THEN 'Doc ' || CAST(user_id % 40 AS VARCHAR) END AS title,
        CASE WHEN event_id % 4 <> 0 THEN value END AS x,
        CASE WHEN event_id % 4 <> 0 THEN -value END AS y
    FROM events
)"""

# FNV-1a over length-prefixed UTF-8 parts, in wide integers modulo 2**64.
_HASH = """
    'v1-' || lpad(lower(hex(CAST(list_reduce(
        list_concat([14695981039346656037::HUGEINT], flatten(list_transform(
            [app_name, coalesce(CAST(process_id AS VARCHAR), ''), coalesce(process_path, ''), title],
            lambda part: list_concat(
                [strlen(part) & 255, (strlen(part) >> 8) & 255, (strlen(part) >> 16) & 255,
                 (strlen(part) >> 24) & 255, 0, 0, 0, 0]::HUGEINT[],
                list_transform(regexp_extract_all(hex(encode(part)), '..'),
                               lambda digits: CAST('0x' || digits AS HUGEINT))
            )))),
        lambda state, byte:
            (xor(state, byte) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT
    ) AS UBIGINT))), 16, '0')"""

_DIM = f"""
seen AS (
    SELECT app_name, process_id, process_path, title,
        min(event_id) AS first_event_id, min(occurred_at) AS first_seen_at,
        max(occurred_at) AS last_seen_at, count(*) AS event_count,
        arg_max(struct_pack(x := x, y := y), event_id) AS place
    FROM ev WHERE has_window GROUP BY app_name, process_id, process_path, title
),
dim AS (
    SELECT row_number() OVER (ORDER BY first_event_id) AS window_id,
        app_name, process_path, process_id, title, place.x AS x, place.y AS y,
        CAST(1280 AS DOUBLE) AS width, CAST(720 AS DOUBLE) AS height,
        first_seen_at, last_seen_at, event_count, {_HASH} AS context_hash
    FROM seen
)"""

_LOG = """
log AS (
    SELECT ev.*, dim.window_id, dim.context_hash, dim.event_count, dim.first_seen_at,
        dim.last_seen_at, dim.x AS wx, dim.y AS wy, dim.width, dim.height
    FROM ev LEFT JOIN dim ON ev.app_name = dim.app_name AND ev.title = dim.title
        AND ev.process_id IS NOT DISTINCT FROM dim.process_id
        AND ev.process_path IS NOT DISTINCT FROM dim.process_path
)"""

_WITH_EV = f"WITH {_EVENTS}"
_WITH_DIM = f"{_WITH_EV},{_DIM}"
_WITH_LOG = f"{_WITH_DIM},{_LOG}"

_EVENT_COLUMNS = ", ".join(EVENT_COLUMNS)
_WINDOW_COLUMNS = (
    "window_id, app_name, process_path, process_id, title, x, y, width, height, "
    "first_seen_at, last_seen_at, event_count, context_hash"
)
_START = "TIMESTAMP '2024-01-05 00:00:00'"
_END = "TIMESTAMP '2024-01-12 12:00:00'"
_RANGE = f"occurred_at >= {_START} AND occurred_at <= {_END}"
_EMPTY = f"occurred_at >= TIMESTAMP '2024-01-12 00:00:00' AND occurred_at <= {_START}"
_HASH_OF_USER = f"(SELECT context_hash FROM dim WHERE process_id = {USER})"


def _matching(condition: str) -> str:
    return f"{_WITH_LOG} SELECT {_EVENT_COLUMNS} FROM log WHERE {condition}"


def _listed(
    offset: int, size: int, column: str = "occurred_at", direction: str = "desc",
    condition: str = "TRUE",
) -> str:
    order = f"{column} {direction} NULLS LAST, event_id {direction}"
    return f"""{_WITH_LOG}
        SELECT row_number() OVER (ORDER BY {order}) - 1 AS pos, {_EVENT_COLUMNS}, has_window,
            app_name, title
        FROM log WHERE {condition} ORDER BY {order} LIMIT {size} OFFSET {offset}"""


def _listed_windows(
    offset: int, size: int, column: str = "last_seen_at", direction: str = "desc",
    condition: str = "TRUE",
) -> str:
    order = f"{column} {direction} NULLS LAST, window_id {direction}"
    return f"""{_WITH_DIM}
        SELECT row_number() OVER (ORDER BY {order}) - 1 AS pos, {_WINDOW_COLUMNS}
        FROM dim WHERE {condition} ORDER BY {order} LIMIT {size} OFFSET {offset}"""


_TOTALS = """
    count(*) AS total_events,
    count(*) FILTER (event_kind IN ('key_press', 'key_release')) AS key_events,
    count(*) FILTER (event_kind IN ('button_press', 'button_release')) AS button_events,
    count(*) FILTER (event_kind = 'wheel') AS wheel_events,
    count(DISTINCT window_id) AS active_windows,
    count(*) FILTER (event_kind IN ('button_press', 'button_release', 'wheel')) AS pointer_events"""


def _totals(condition: str) -> str:
    return f"{_WITH_LOG} SELECT {_TOTALS} FROM log WHERE {condition}"


def _top_select(condition: str) -> str:
    return f"""
        SELECT row_number() OVER (ORDER BY event_count DESC, app_name) AS pos, app_name, event_count,
            CAST(event_count AS DOUBLE)
                / CAST((SELECT count(*) FROM log WHERE {condition}) AS DOUBLE) * 100.0 AS share
        FROM (SELECT coalesce(app_name, 'Unknown') AS app_name, count(*) AS event_count
              FROM log WHERE {condition} GROUP BY 1)
        ORDER BY event_count DESC, app_name LIMIT 10"""


def _summary_row(condition: str) -> str:
    return f"""{_WITH_LOG}, top AS ({_top_select(condition)})
    SELECT {_TOTALS},
        coalesce((SELECT string_agg(app_name || '=' || CAST(event_count AS VARCHAR), ';' ORDER BY pos)
         FROM top), '') AS top_apps
    FROM log WHERE {condition}"""


_SUMMARY_ROW = _summary_row("TRUE")


def _between(start: str, end: str) -> str:
    return f"occurred_at >= TIMESTAMP '{start}' AND occurred_at <= TIMESTAMP '{end}'"


_SHOWN_VALUE = """CASE WHEN event_kind = 'wheel' AND event_value = ''
    THEN 'delta_x:' || CAST(CAST(coalesce(delta_x, 0) AS BIGINT) AS VARCHAR)
        || ', delta_y:' || CAST(CAST(coalesce(delta_y, 0) AS BIGINT) AS VARCHAR)
    ELSE event_value END"""

_COMPACT = (
    "CAST(year({0}) AS VARCHAR) || '.' || CAST(month({0}) AS VARCHAR) || '.' "
    "|| CAST(day({0}) AS VARCHAR) || strftime({0}, ' %H:%M:%S')"
)

# Captured records: 11ths are pointer moves and 13ths another type, both dropped.
_CAPTURED = """
cap AS (
    SELECT event_id,
        ts - to_seconds((event_id * 7919) % 864000) AS occurred_at,
        CASE event_type WHEN 'signup' THEN 'key_press' WHEN 'purchase' THEN 'key_release'
            WHEN 'click' THEN 'button_press' WHEN 'error' THEN 'button_release'
            WHEN 'view' THEN 'wheel' END AS kind,
        event_type = 'view' AS is_wheel,
        'Key' || CAST(event_id % 26 AS VARCHAR) AS detail,
        CASE WHEN event_id % 2 = 0 THEN 'k' END AS key_name,
        event_id % 7 - 3 AS dx, event_id % 5 - 2 AS dy,
        user_id % 10 <> 0 AS has_window,
        CASE WHEN event_id % 5 < 2 THEN '' ELSE 'Doc ' || CAST(user_id % 40 AS VARCHAR) END AS title,
        'App ' || CAST(user_id % 12 AS VARCHAR) AS app_name,
        CASE WHEN user_id % 3 = 0 THEN '' ELSE '/opt/app' || CAST(user_id % 12 AS VARCHAR) END
            AS process_path,
        user_id, value AS v
    FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
),
shaped AS (
    SELECT *,
        CASE WHEN is_wheel THEN 'delta_x:' || CAST(dx AS VARCHAR) || ', delta_y:' || CAST(dy AS VARCHAR)
            ELSE detail END AS value,
        CASE WHEN is_wheel THEN CAST(dx AS DOUBLE) END AS delta_x,
        CASE WHEN is_wheel THEN CAST(dy AS DOUBLE) END AS delta_y
    FROM cap
)"""

_FAULTS = """CASE event_id % 20 WHEN 0 THEN 'not_json' WHEN 1 THEN 'unknown_kind'
    WHEN 2 THEN 'bad_field:value' WHEN 3 THEN 'bad_field:collector_name'
    WHEN 4 THEN 'bad_field:window.title' WHEN 5 THEN 'bad_field:window.process_id'
    WHEN 6 THEN 'bad_field:occurred_at' WHEN 7 THEN 'not_json' END"""

_EVENT_RULES = (
    "event_id", "occurred_at", "event_kind", "event_value",
    "collector_name", "collector_version", "created_at",
)
_WINDOW_RULES = (
    "window_id", "app_name", "title", "first_seen_at", "last_seen_at", "event_count", "context_hash",
)


def _report(events: str, windows: str) -> str:
    parts = [
        f"SELECT '{table}' AS table_name, 'not_null:{name}' AS rule, "
        f"count(*) FILTER ({name} IS NULL) AS violations FROM {source}"
        for table, source, names in (
            ("input_events", events, _EVENT_RULES),
            ("observed_windows", windows, _WINDOW_RULES),
        )
        for name in names
    ]
    parts.append(
        f"""SELECT 'input_events', 'known_kind', count(*) FILTER (event_kind NOT IN
            ('key_press', 'key_release', 'button_press', 'button_release', 'wheel')) FROM {events}"""
    )
    parts += [
        f"""SELECT '{table}', 'unique:{key}', count(*) FROM
            (SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) > 1)"""
        for table, source, key in (
            ("input_events", events, "event_id"),
            ("observed_windows", windows, "window_id"),
            ("observed_windows", windows, "context_hash"),
        )
    ]
    parts.append(
        f"""SELECT 'input_events', 'references:window_id', count(*) FROM {events} e
            WHERE window_id IS NOT NULL AND NOT EXISTS
            (SELECT 1 FROM {windows} w WHERE w.window_id = e.window_id)"""
    )
    return " UNION ALL ".join(parts)


_CLEAN = f"{_WITH_LOG}, stored AS (SELECT *, occurred_at AS created_at FROM log)"
_DAMAGED = f"""{_WITH_LOG},
    stored AS (
        SELECT CASE WHEN event_id % 101 = 0 THEN event_id + 1 ELSE event_id END AS event_id,
            occurred_at,
            CASE WHEN event_id % 97 = 0 THEN 'key_hold' ELSE event_kind END AS event_kind,
            CASE WHEN event_id % 89 <> 0 THEN event_value END AS event_value,
            CASE WHEN event_id % 83 = 0 THEN -1 ELSE window_id END AS window_id,
            collector_name, collector_version, occurred_at AS created_at
        FROM log
    ),
    damaged AS (
        SELECT window_id, app_name, CASE WHEN window_id % 6 <> 0 THEN title END AS title,
            first_seen_at, last_seen_at, event_count,
            CASE WHEN window_id % 5 = 0 THEN 'v1-0' ELSE context_hash END AS context_hash
        FROM dim
    )"""


def _number_text(value: str) -> str:
    """SQL for a double's text: plain from 1e-6 up to 1e21, else with an exponent."""
    return f"""(
    SELECT CASE WHEN v = 0 THEN '0' ELSE CASE WHEN v < 0 THEN '-' ELSE '' END ||
        CASE WHEN point > 21 OR point < -5 THEN
                left(digits, 1) || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END
                || CASE WHEN point < 1 THEN 'e-' ELSE 'e+' END || CAST(abs(point - 1) AS VARCHAR)
            WHEN point <= 0 THEN '0.' || repeat('0', -point) || digits
            WHEN point >= length(digits) THEN digits || repeat('0', point - length(digits))
            ELSE left(digits, point) || '.' || substr(digits, point + 1) END END
    FROM (
        SELECT v, rtrim(ltrim(raw, '0'), '0') AS digits,
            CAST(length(whole) + exponent - (length(raw) - length(ltrim(raw, '0'))) AS INTEGER) AS point
        FROM (
            SELECT v, split_part(mantissa, '.', 1) AS whole, replace(mantissa, '.', '') AS raw, exponent
            FROM (
                SELECT v, split_part(t, 'e', 1) AS mantissa,
                    CASE WHEN contains(t, 'e') THEN CAST(split_part(t, 'e', 2) AS INTEGER) ELSE 0 END AS exponent
                FROM (SELECT v, CAST(abs(v) AS VARCHAR) AS t FROM (SELECT {value} AS v))
            )
        )
    ))"""


def _delta(shift: int) -> str:
    factor, divisor = (
        f"([{', '.join(f'{s[i]!r}::DOUBLE' for s in SCALES)}])[1 + (event_id + {shift}) % {len(SCALES)}]"
        for i in (0, 1)
    )
    return f"CAST(floor(value * 100) AS DOUBLE) * {factor} / {divisor}"


_FROM_LINES = f"""{_WITH_EV}
    SELECT event_id, occurred_at, event_kind, event_value, delta_x, delta_y,
        app_name, process_path, process_id, title, collector_name, collector_version
    FROM ev WHERE event_id % 20 > 8"""


def oracle_sql() -> dict[str, str]:
    dimension = f"{_WITH_DIM} SELECT {_WINDOW_COLUMNS} FROM dim"
    user_filters = f"""{_RANGE.replace(_END, "TIMESTAMP '2024-01-25 00:00:00'")}
        AND event_kind = 'button_press' AND lower(app_name) LIKE '%pp 7%' AND app_name = 'App 7'
        AND context_hash = {_HASH_OF_USER}"""
    sql = {
        "context_hash": f"""{_WITH_EV},
            ids AS (SELECT DISTINCT app_name, process_id, process_path, title FROM ev WHERE has_window)
            SELECT *, {_HASH} AS context_hash FROM ids""",
        "window_dimension": dimension,
        "dimension_incremental": dimension,
        "dimension_streaming": dimension,
        "dimension_running": dimension,
        "event_window_assignment": f"{_WITH_LOG} SELECT event_id, window_id FROM log",
        "event_by_id": _matching(f"event_id = {EVENT_ID}"),
        "window_by_id": f"{dimension} WHERE window_id = {WINDOW_ID}",
        "window_by_hash": f"{dimension} WHERE context_hash = {_HASH_OF_USER}",
        "events_with_window": f"""{_WITH_LOG}
            SELECT {_EVENT_COLUMNS}, has_window, app_name, process_path, process_id, title,
                wx AS x, wy AS y, width, height, first_seen_at, last_seen_at, event_count, context_hash
            FROM log""",
        "events_from": _matching(f"occurred_at >= {_START}"),
        "events_until": _matching(f"occurred_at <= {_END}"),
        "events_range": _matching(_RANGE),
        "events_empty_range": _matching(f"occurred_at >= {_END} AND occurred_at <= {_START}"),
        "events_by_kind": _matching("event_kind = 'wheel'"),
        "events_by_window": _matching(f"window_id = {WINDOW_ID}"),
        "events_search": _matching("lower(app_name) LIKE '%app 1%'"),
        "events_search_wildcard": _matching("lower(app_name) LIKE '%p%1_%'"),
        "events_search_backslash": _matching("lower(app_name) LIKE lower('%App\\%')"),
        "events_search_blank": _matching("TRUE"),
        "events_by_app": _matching("app_name = 'App 3'"),
        "events_by_hash": _matching(f"context_hash = {_HASH_OF_USER}"),
        "events_all_filters": _matching(user_filters),
        "events_count": f"""{_WITH_LOG} SELECT count(*) AS total FROM log
            WHERE occurred_at >= {_START} AND lower(app_name) LIKE '%app 1%'""",
        "events_sorted_all": f"""{_WITH_EV}
            SELECT row_number() OVER (ORDER BY occurred_at DESC, event_id DESC) - 1 AS pos, event_id
            FROM ev""",
        "events_page": _listed(25, 25),
        "events_page_filtered": _listed(
            80, 40,
            condition=f"occurred_at >= {_START} AND event_kind = 'wheel' AND lower(app_name) LIKE '%app%'",
        ),
        "events_cursor": _listed(30, 20),
        "events_past_end": _listed((10**9 - 1) * 100, 100),
        "events_size_clamped": _listed(0, 1000),
        "events_page_info": f"""{_WITH_EV}
            SELECT CAST(3 AS BIGINT) AS page, CAST(60 AS BIGINT) AS size, count(*) AS total,
                CAST(ceil(count(*) / 60.0) AS BIGINT) AS pages
            FROM ev WHERE event_kind = 'wheel'""",
        "windows_search": _listed_windows(0, 100, condition="lower(app_name) LIKE '%pp 1%'"),
        "windows_by_app": _listed_windows(0, 100, condition="app_name = 'App 3'"),
        "windows_by_hash": _listed_windows(0, 100, condition=f"context_hash = {_HASH_OF_USER}"),
        "windows_page": _listed_windows(5, 5),
        "windows_cursor": _listed_windows(3, 4),
        "windows_page_info": f"""{_WITH_DIM}
            SELECT CAST(2 AS BIGINT) AS page, CAST(7 AS BIGINT) AS size, count(*) AS total,
                CAST(ceil(count(*) / 7.0) AS BIGINT) AS pages
            FROM dim WHERE lower(app_name) LIKE '%app 1%'""",
        "summary_days": _SUMMARY_ROW,
        "summary_days_range": _summary_row(_RANGE),
        "summary_days_cut": _summary_row(_between("2024-01-05 07:30:00", "2024-01-12 23:59:59")),
        "summary_days_one": _summary_row(_between("2024-01-05 07:30:00", "2024-01-05 19:45:10")),
        "summary_days_empty": _summary_row(_EMPTY),
        "summary_totals": _totals("TRUE"),
        "summary_totals_range": _totals(_RANGE),
        "summary_empty_range": _totals(_EMPTY),
        "top_apps": f"{_WITH_LOG} {_top_select('TRUE')}",
        "top_apps_range": f"{_WITH_LOG} {_top_select(_RANGE)}",
        "top_apps_empty_range": f"{_WITH_LOG} {_top_select(_EMPTY)}",
        "activity_summary": _SUMMARY_ROW,
        "summary_running": _SUMMARY_ROW,
        "last_event_at": f"{_WITH_EV} SELECT max(occurred_at) AS last_event_at FROM ev",
        "recent_events": f"""{_WITH_LOG}
            SELECT row_number() OVER (ORDER BY occurred_at DESC, event_id DESC) - 1 AS pos,
                event_id AS id, occurred_at, event_kind AS kind, {_SHOWN_VALUE} AS value,
                coalesce(app_name, 'Unknown') AS app_name, coalesce(title, '') AS window_title,
                window_id
            FROM log ORDER BY occurred_at DESC, event_id DESC LIMIT 10""",
        "event_detail": f"""{_WITH_LOG}
            SELECT {_EVENT_COLUMNS}, {_SHOWN_VALUE} AS value, TRUE AS raw_event_is_json,
                FALSE AS raw_window_is_json, app_name, event_count AS window_event_count
            FROM log WHERE event_id = {EVENT_ID}""",
        "window_events": _listed(0, 25, condition=f"window_id = {WINDOW_ID}"),
        "event_list_items": f"""{_WITH_LOG}
            SELECT event_id AS id, occurred_at, event_kind AS kind, {_SHOWN_VALUE} AS value,
                coalesce(app_name, 'Unknown') AS app_name, coalesce(title, '') AS window_title,
                collector_name, collector_version, window_id
            FROM log""",
        "event_display": f"""{_WITH_EV}
            SELECT event_id AS id,
                {_COMPACT.format("(occurred_at + INTERVAL 8 HOUR)")} AS occurred_text,
                CASE event_kind WHEN 'key_press' THEN '按键按下' WHEN 'key_release' THEN '按键释放'
                    WHEN 'button_press' THEN '鼠标按下' WHEN 'button_release' THEN '鼠标释放'
                    ELSE '滚轮' END AS kind_label,
                {_SHOWN_VALUE} AS value, 'listener unknown' AS collector
            FROM ev""",
        "window_display": f"""{_WITH_DIM}
            SELECT window_id, '1280 x 720' AS size_text,
                coalesce(CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) || ', '
                    || CAST(CAST(floor(y + 0.5) AS BIGINT) AS VARCHAR), '-') AS position_text,
                {_COMPACT.format("first_seen_at")} AS first_seen_text,
                {_COMPACT.format("last_seen_at")} AS last_seen_text
            FROM dim""",
        "raw_json_validity": "SELECT event_id, event_id % 3 = 2 AS is_json FROM events",
        "raw_json_repeats": """
            SELECT event_id, event_id % 3 < 2 AS is_json,
                CASE WHEN event_id % 3 = 0 THEN 'a' ELSE '' END AS repeated
            FROM events""",
        "ingest_repeated_members": f"""{_WITH_EV},
            judged AS (
                SELECT *, event_id % 6 IN (2, 5) OR (event_id % 6 = 3 AND has_window) AS refused FROM ev
            )
            SELECT event_id, CASE WHEN refused THEN 'not_json' ELSE 'valid' END AS state,
                CASE WHEN NOT refused THEN event_kind END AS kind,
                CASE WHEN has_window AND NOT refused THEN title END AS title
            FROM judged""",
        "capture_normalized": f"""WITH {_CAPTURED}
            SELECT event_id, occurred_at, kind, value, delta_x, delta_y,
                CASE WHEN has_window THEN app_name END AS app_name,
                CASE WHEN has_window THEN nullif(process_path, '') END AS process_path,
                CASE WHEN has_window THEN user_id END AS process_id,
                CASE WHEN has_window THEN title END AS title,
                CASE WHEN has_window THEN v END AS x, CASE WHEN has_window THEN -v END AS y,
                CASE WHEN has_window THEN CAST(1280 AS DOUBLE) END AS width,
                CASE WHEN has_window THEN CAST(720 AS DOUBLE) END AS height,
                'listener' AS collector_name, '0.1.0' AS collector_version
            FROM shaped""",
        "capture_raw_json": f"""WITH {_CAPTURED}
            SELECT event_id, 8 AS event_fields, kind, value, delta_x, delta_y, key_name,
                CASE WHEN microsecond(occurred_at) % 1000000 = 0
                        THEN strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ')
                    WHEN microsecond(occurred_at) % 1000 = 0
                        THEN strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%gZ')
                    ELSE strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') END AS occurred_text,
                'listener' AS collector_name, '0.1.0' AS collector_version,
                CASE WHEN has_window THEN 6 ELSE 0 END AS window_fields,
                CASE WHEN has_window THEN app_name END AS app_name,
                CASE WHEN has_window THEN title END AS title,
                CASE WHEN has_window THEN process_path END AS process_path,
                CASE WHEN has_window THEN user_id END AS process_id,
                CASE WHEN has_window THEN v END AS x,
                CASE WHEN has_window THEN CAST(720 AS DOUBLE) END AS height
            FROM shaped""",
        "ingest_valid": f"""{_WITH_EV}
            SELECT event_id, occurred_at, event_kind AS kind, event_value AS value, delta_x, delta_y,
                app_name, process_path, process_id, title,
                CASE WHEN has_window THEN x END AS x, CASE WHEN has_window THEN y END AS y,
                CASE WHEN has_window THEN CAST(1280 AS DOUBLE) END AS width,
                CASE WHEN has_window THEN CAST(720 AS DOUBLE) END AS height,
                collector_name, collector_version
            FROM ev WHERE event_id % 20 > 8""",
        "ingest_quarantine": f"SELECT event_id, {_FAULTS} AS reason FROM events WHERE event_id % 20 < 8",
        "lines_to_store": _FROM_LINES,
        "lines_stream": _FROM_LINES,
        "lines_quarantined": f"SELECT event_id, {_FAULTS} AS reason FROM events WHERE event_id % 20 < 8",
        "ingest_without_ids": f"""{_WITH_LOG}
            SELECT row_number() OVER (ORDER BY event_id) AS event_id, occurred_at, event_kind,
                event_value, window_id FROM log""",
        "ingest_duplicate_ids": """
            SELECT event_id, 'stored' AS state, CAST(1 AS BIGINT) AS rows FROM events
            UNION ALL
            SELECT event_id, 'duplicate:event_id',
                CAST((event_id % 10 = 0)::INTEGER + (event_id % 7 = 0)::INTEGER AS BIGINT)
            FROM events WHERE event_id % 10 = 0 OR event_id % 7 = 0""",
        "dimension_compacted": dimension,
        "wheel_value_text": f"""
            WITH d AS (SELECT event_id, {_delta(0)} AS x, {_delta(3)} AS y FROM events)
            SELECT event_id, 'delta_x:' || {_number_text("x")} || ', delta_y:' || {_number_text("y")} AS shown
            FROM d""",
        "constraint_report": f"{_CLEAN} {_report('stored', 'dim')}",
        "constraint_report_damaged": f"{_DAMAGED} {_report('stored', 'damaged')}",
        "free_sql": f"""{_WITH_LOG}
            SELECT title, count(*) AS events, max(occurred_at) AS newest
            FROM log WHERE event_kind = 'wheel' AND window_id IS NOT NULL GROUP BY title""",
    }
    columns = {
        "occurred_at": "occurred_at", "event_id": "event_id", "kind": "event_kind",
        "value": "event_value", "app_name": "app_name",
    }
    for direction in ("asc", "desc"):
        for key, column in columns.items():
            sql[f"events_deep_{key}_{direction}"] = _listed(6200, 400, column, direction)
            sql[f"events_sort_{key}_{direction}"] = _listed(
                EVENT_SORT_CURSOR, SORT_SIZE, column, direction
            )
        for column in ("last_seen_at", "first_seen_at", "window_id", "app_name", "event_count"):
            sql[f"windows_sort_{column}_{direction}"] = _listed_windows(
                WINDOW_SORT_CURSOR, SORT_SIZE, column, direction
            )
    return sql
