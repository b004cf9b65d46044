"""Queries over requests: events stand in for the request log."""

from __future__ import annotations

from kilnspark.operators import expiry as x
from kilnspark.operators import telemetry as t
from kilnspark.sources import corpus as c

QUERIES = {
    "endpoint_stats": lambda s, d: t.endpoint_stats(c.requests(s, d)),
    "latency_percentiles": lambda s, d: t.latency_percentiles(c.requests(s, d)),
    "status_families": lambda s, d: t.status_families(c.requests(s, d)),
    "hourly_windows": lambda s, d: t.tumbling(c.requests(s, d), "hour"),
    "daily_totals": lambda s, d: t.tumbling(c.requests(s, d), "day"),
    "rate_window_usage": lambda s, d: t.rate_window_usage(c.requests(s, d), 86400),
    "rate_limit_decisions": lambda s, d: t.rate_limit_decisions(c.requests(s, d), 3, 86400),
    "idle_sessions": lambda s, d: t.idle_sessions(c.requests(s, d), "6 hours"),
    "latest_progress": lambda s, d: t.latest_progress(c.requests(s, d)),
    "change_only": lambda s, d: t.change_only(c.requests(s, d)),
    "hourly_log": lambda s, d: t.hourly_log(c.requests(s, d)),
    "cache_replay": lambda s, d: x.cache_replay(c.requests(s, d)),
    "mail_caps": lambda s, d: x.mail_caps(c.requests(s, d), 2, 86400),
    "touched_sessions": lambda s, d: x.sessions(c.requests(s, d), 2 * 86400),
    "fixed_sessions": lambda s, d: x.sessions(c.requests(s, d), 2 * 86400, touch=False),
    "recent_errors": lambda s, d: t.recent_errors(c.requests(s, d)),
    "top_users": lambda s, d: t.top_users(c.requests(s, d)),
}

_R = "r AS (SELECT event_id AS id, ts, user_id, event_type AS endpoint, trunc(value)::BIGINT AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events)"
_TUMBLING = f"WITH {_R} SELECT date_trunc('{{}}', ts)::TIMESTAMP AS bucket, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors, round(avg(duration_ms), 2) AS avg_ms, count(DISTINCT user_id) AS users FROM r GROUP BY 1"

ORACLE = {
    "endpoint_stats": f"""WITH {_R} SELECT endpoint, count(*) AS hits, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE status >= 400) AS errors, round(avg(duration_ms), 2) AS avg_ms, max(duration_ms) AS max_ms,
  round(count(*) FILTER (WHERE status >= 400) * 100 / count(*), 2) AS error_rate FROM r GROUP BY endpoint""",
    "latency_percentiles": f"""WITH {_R}, k AS (SELECT endpoint, duration_ms, row_number() OVER (PARTITION BY endpoint ORDER BY duration_ms) AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM r)
SELECT endpoint, max(n) AS requests, {", ".join(f"max(duration_ms) FILTER (WHERE i = greatest(1, floor(n * {p} / 100))) AS p{p}" for p in (50, 95, 99))} FROM k GROUP BY endpoint""",
    "status_families": f"WITH {_R} SELECT (status // 100)::VARCHAR || 'xx' AS family, count(*) AS requests FROM r GROUP BY 1",
    "hourly_windows": _TUMBLING.format("hour"),
    "daily_totals": _TUMBLING.format("day"),
    "rate_window_usage": f"WITH {_R} SELECT id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM r",
    "rate_limit_decisions": f"""WITH RECURSIVE {_R}, o AS (SELECT id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS i FROM r),
w AS (
  SELECT id, user_id, i, true AS allowed, [us] AS recent FROM o WHERE i = 1
  UNION ALL
  SELECT o.id, o.user_id, o.i, len(list_filter(w.recent, lambda x: x > o.us - 86400000000)) < 3,
    CASE WHEN len(list_filter(w.recent, lambda x: x > o.us - 86400000000)) < 3 THEN list_append(list_filter(w.recent, lambda x: x > o.us - 86400000000), o.us) ELSE list_filter(w.recent, lambda x: x > o.us - 86400000000) END
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1
) SELECT id, user_id, allowed, len(recent)::BIGINT AS used FROM w""",
    "idle_sessions": f"""WITH {_R}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM r),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS requests FROM s GROUP BY user_id, k""",
    "latest_progress": f"""WITH {_R} SELECT user_id, count(*) OVER (PARTITION BY user_id) AS updates, id, endpoint, duration_ms FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1""",
    "change_only": f"""WITH {_R}, l AS (SELECT id, user_id, endpoint, lag(endpoint) OVER (PARTITION BY user_id ORDER BY ts, id) AS before FROM r) SELECT * FROM l WHERE before IS DISTINCT FROM endpoint""",
    "hourly_log": f"""WITH {_R} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts DESC, id DESC)::INT AS place, id, endpoint, status FROM r QUALIFY place <= 100""",
    "cache_replay": f"""WITH RECURSIVE {_R}, k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {s * 1000000}::BIGINT)" for k, s in x.CACHE_SECONDS.items())}) k(kind, ttl)),
p AS MATERIALIZED (SELECT endpoint, epoch_us(ts) AS us, count(*) AS n FROM r WHERE endpoint IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
m AS (SELECT kind, ttl, endpoint, min(us) AS us FROM p, k GROUP BY ALL UNION ALL SELECT m.kind, m.ttl, m.endpoint, min(p.us) FROM m JOIN p ON p.endpoint = m.endpoint AND p.us >= m.us + m.ttl GROUP BY ALL),
a AS (SELECT kind, endpoint, count(*) AS misses FROM m GROUP BY ALL), b AS (SELECT endpoint, sum(n)::BIGINT AS requests FROM p GROUP BY 1)
SELECT kind, endpoint, requests, requests - misses AS hits, misses, round((requests - misses) * 100 / requests, 2) AS hit_rate FROM a JOIN b USING (endpoint)""",
    "mail_caps": f"""WITH RECURSIVE {_R}, o AS (SELECT id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS i FROM r),
w AS (SELECT id, user_id, i, true AS allowed, 1 AS n, us AS last FROM o WHERE i = 1
  UNION ALL
  SELECT o.id, o.user_id, o.i, o.us >= w.last + 86400000000 OR w.n < 2, CASE WHEN o.us >= w.last + 86400000000 THEN 1 WHEN w.n < 2 THEN w.n + 1 ELSE w.n END, CASE WHEN o.us >= w.last + 86400000000 OR w.n < 2 THEN o.us ELSE w.last END
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT id, user_id, allowed, (2 - n)::INT AS remaining FROM w""",
    "touched_sessions": f"""WITH {_R}, g AS (SELECT user_id, ts, id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) < INTERVAL 2 DAYS THEN 0 ELSE 1 END AS opens FROM r),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS requests FROM s GROUP BY user_id, k""",
    "fixed_sessions": f"""WITH RECURSIVE {_R}, m AS (SELECT user_id, min(ts) AS first_ts FROM r GROUP BY 1 UNION ALL SELECT m.user_id, min(r.ts) FROM m JOIN r ON r.user_id = m.user_id AND r.ts >= m.first_ts + INTERVAL 2 DAYS GROUP BY m.user_id, m.first_ts)
SELECT m.user_id, first_ts, max(ts) AS last_ts, count(*) AS requests FROM m JOIN r ON r.user_id = m.user_id AND ts >= first_ts AND ts < first_ts + INTERVAL 2 DAYS GROUP BY 1, 2""",
    "recent_errors": f"WITH {_R} SELECT id, user_id, endpoint, status FROM r WHERE status >= 400 ORDER BY ts DESC, id DESC LIMIT 50",
    "top_users": f"""WITH {_R}, n AS (SELECT endpoint, user_id, count(*) AS requests FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY requests DESC, user_id)::INT AS place FROM n QUALIFY place <= 5""",
}
