"""SQL that gives the rows of the queries whose outcomes depend on all rows before: recursive, one row after the other."""

from __future__ import annotations

_HOUR = 3_600_000_000

ORACLE_SQL = {
    "guard_outcomes": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        f AS (SELECT 0::BIGINT AS k, user_id, NULL::BIGINT AS event_id, NULL::BIGINT AS t, []::BIGINT[] AS times, false AS rejected FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL SELECT o.k, o.user_id, o.event_id, o.t, CASE WHEN len(r.recent) >= 2 THEN r.recent ELSE list_append(r.recent, o.t) END, len(r.recent) >= 2
            FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1, LATERAL (SELECT list_filter(f.times, lambda x: o.t - x < {_HOUR}) AS recent) r),
        p AS MATERIALIZED (SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) AS k FROM f WHERE NOT rejected AND event_id IS NOT NULL),
        g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS event_id, []::BIGINT[] AS times, false AS rejected
            UNION ALL SELECT p.k, p.event_id, CASE WHEN len(r.recent) >= 15 THEN r.recent ELSE list_append(r.recent, p.t) END, len(r.recent) >= 15
            FROM g JOIN p ON p.k = g.k + 1, LATERAL (SELECT list_filter(g.times, lambda x: p.t - x < {_HOUR}) AS recent) r)
        SELECT event_id, CASE WHEN rejected THEN 'globally_limited' ELSE 'passed' END AS outcome FROM g WHERE k > 0
        UNION ALL SELECT event_id, 'client_limited' FROM f WHERE rejected""",
    "guard_chain": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 5 = 0 THEN 'method_not_allowed'
                WHEN event_id % 7 = 0 OR (event_id % 7 = 1 AND event_id % 2 <> 0) THEN 'forbidden' END AS stopped FROM events),
        o AS MATERIALIZED (SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e WHERE stopped IS NULL),
        f AS (SELECT event_id, user_id, k, t, t AS last, false AS rejected FROM o WHERE k = 1
            UNION ALL SELECT o.event_id, o.user_id, o.k, o.t, CASE WHEN o.t - f.last >= {_HOUR} THEN o.t ELSE f.last END, o.t - f.last < {_HOUR} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
        p AS MATERIALIZED (SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) AS k FROM f WHERE NOT rejected),
        g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS event_id, []::BIGINT[] AS times, false AS rejected
            UNION ALL SELECT p.k, p.event_id, CASE WHEN len(r.recent) >= 9 THEN r.recent ELSE list_append(r.recent, p.t) END, len(r.recent) >= 9
            FROM g JOIN p ON p.k = g.k + 1, LATERAL (SELECT list_filter(g.times, lambda x: p.t - x < {_HOUR}) AS recent) r)
        SELECT event_id, CASE WHEN rejected THEN 'globally_limited' ELSE 'passed' END AS outcome FROM g WHERE k > 0
        UNION ALL SELECT event_id, 'client_limited' FROM f WHERE rejected UNION ALL SELECT event_id, stopped FROM e WHERE stopped IS NOT NULL""",
    "capped_cache": """WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, event_type || '|' || user_id % 40 AS key, event_id % 11 = 0 AS failed, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
        c AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS key, NULL::BOOLEAN AS hit, []::VARCHAR[] AS keys, []::BIGINT[] AS made
            UNION ALL SELECT o.k, o.event_id, o.key, h.hit,
                CASE WHEN h.hit THEN c.keys WHEN o.failed THEN list_filter(s.keys, lambda x: x <> o.key) ELSE s.keys END,
                CASE WHEN h.hit THEN c.made WHEN o.failed THEN list_concat(s.made[:list_position(s.keys, o.key) - 1], s.made[list_position(s.keys, o.key) + 1:]) ELSE s.made END
            FROM c JOIN o ON o.k = c.k + 1,
                LATERAL (SELECT coalesce(list_position(c.keys, o.key), 0) AS p, coalesce(o.t - c.made[list_position(c.keys, o.key)] < 36000000000, false) AS hit) h,
                LATERAL (SELECT CASE WHEN h.p > 0 THEN c.keys WHEN len(c.keys) >= 60 THEN list_append(c.keys[2:], o.key) ELSE list_append(c.keys, o.key) END AS keys,
                    CASE WHEN h.p > 0 THEN list_concat(list_append(c.made[:h.p - 1], o.t), c.made[h.p + 1:]) WHEN len(c.keys) >= 60 THEN list_append(c.made[2:], o.t) ELSE list_append(c.made, o.t) END AS made) s)
        SELECT event_id, key, hit FROM c WHERE k > 0""",
    "clients_reset": """WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
        c AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, NULL::BOOLEAN AS rejected, []::BIGINT[] AS users, []::BIGINT[] AS last
            UNION ALL SELECT o.k, o.event_id, o.user_id, h.rejected,
                CASE WHEN h.rejected THEN c.users WHEN len(s.users) > 30 THEN [] ELSE s.users END, CASE WHEN h.rejected THEN c.last WHEN len(s.users) > 30 THEN [] ELSE s.last END
            FROM c JOIN o ON o.k = c.k + 1,
                LATERAL (SELECT coalesce(list_position(c.users, o.user_id), 0) AS p, coalesce(o.t - c.last[list_position(c.users, o.user_id)] < 14400000000, false) AS rejected) h,
                LATERAL (SELECT CASE WHEN h.p > 0 THEN c.users ELSE list_append(c.users, o.user_id) END AS users,
                    CASE WHEN h.p > 0 THEN list_concat(list_append(c.last[:h.p - 1], o.t), c.last[h.p + 1:]) ELSE list_append(c.last, o.t) END AS last) s)
        SELECT event_id, user_id, rejected FROM c WHERE k > 0""",
    "lookup_progress": """WITH a AS (SELECT event_id, epoch_us(ts) AS asked, event_id % 50 AS s, 'verified' AS status FROM events WHERE event_id % 7 <> 0
            UNION ALL SELECT event_id, epoch_us(ts), event_id % 40 + 5, 'mismatch' FROM events WHERE event_id % 3 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s, status) AS k FROM a WHERE s < 30)
        SELECT e.event_id AS ref_id, coalesce(r.status, 'lookup_incomplete') AS status, epoch_us(e.ts) + coalesce(r.s, 30) * 1000000 AS completed_us FROM events e LEFT JOIN r ON r.event_id = e.event_id AND k = 1""",
}
