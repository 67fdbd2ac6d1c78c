"""DuckDB SQL with the result of each query, written from the semantics, not from the plans."""

from __future__ import annotations

_DIMS = """
tracks AS (SELECT p_partkey AS track_id, p_name AS name, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS album_id, CAST((p_partkey % 240 + 60) * 1000 AS BIGINT) AS duration_ms, p_size AS popularity FROM part),
albums AS (SELECT DISTINCT p_brand AS album_id, p_brand AS name FROM part),
artists AS (SELECT s_suppkey AS artist_id, s_name AS name, [n_name, r_name] AS genres FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
track_artists AS (SELECT * FROM (SELECT track_id, artist_id, row_number() OVER (PARTITION BY track_id ORDER BY artist_id) - 1 AS position FROM (SELECT DISTINCT l_partkey AS track_id, l_suppkey AS artist_id FROM lineitem)) WHERE position < 3),
playlists AS (SELECT s_suppkey AS playlist_id, CAST(n_regionkey AS BIGINT) AS user_id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
playlist_tracks AS (SELECT playlist_id, track_id, row_number() OVER (PARTITION BY playlist_id ORDER BY track_id) - 1 AS position FROM (SELECT DISTINCT l_suppkey AS playlist_id, l_partkey AS track_id FROM lineitem)),
merge_rules AS (SELECT CAST(u AS BIGINT) AS user_id, s AS source_id, t AS target_id FROM (VALUES (0, 'Brand#24', 'Brand#1'), (1, 'Brand#24', 'Brand#1'), (1, 'Brand#25', 'Brand#1'), (2, 'Brand#25', 'Brand#2')) v(u, s, t))"""
STAR = "WITH plays AS (SELECT CAST(n_regionkey AS BIGINT) AS user_id, o_orderdate AS played_at, l_partkey AS track_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)," + _DIMS
EVENTS = "WITH plays AS (SELECT event_id AS play_id, user_id, ts AS played_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id, event_type AS context_type FROM events)," + _DIMS
STAR_NOW, EVENTS_NOW = "TIMESTAMP '2001-08-02'", "TIMESTAMP '2024-01-31'"

_FACTS = {
    "track": "SELECT p.user_id, p.played_at, t.track_id AS entity_id, t.duration_ms FROM plays p JOIN tracks t USING (track_id)",
    "artist": "SELECT p.user_id, p.played_at, a.artist_id AS entity_id, t.duration_ms FROM plays p JOIN tracks t USING (track_id) JOIN track_artists a USING (track_id)",
    "album": "SELECT p.user_id, p.played_at, coalesce(m.target_id, t.album_id) AS entity_id, t.duration_ms FROM plays p JOIN tracks t USING (track_id) LEFT JOIN merge_rules m ON m.user_id = p.user_id AND m.source_id = t.album_id WHERE t.album_id IS NOT NULL",
}
_COUNTS = "count(*) AS play_count, CAST(sum(duration_ms) AS BIGINT) AS total_ms"


def facts(entity: str, binding: str = STAR) -> str:
    return f"{binding}, facts AS ({_FACTS[entity]})"


def _top(entity: str, binding: str, start: str, before: str | None, metric: str = "total_ms") -> str:
    now = f"now_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {metric} DESC, entity_id) AS rank FROM (SELECT user_id, entity_id, {_COUNTS} FROM facts WHERE {start} GROUP BY ALL)) WHERE rank <= 50)"
    if before is None:
        return f"{facts(entity, binding)}, {now} SELECT *, CAST(NULL AS BIGINT) AS previous_rank, CAST(NULL AS BIGINT) AS rank_change, false AS is_new FROM now_"
    old = f"old_ AS (SELECT * FROM (SELECT user_id, entity_id, row_number() OVER (PARTITION BY user_id ORDER BY {metric} DESC, entity_id) AS previous_rank FROM (SELECT user_id, entity_id, {_COUNTS} FROM facts WHERE {before} GROUP BY ALL)) WHERE previous_rank <= 200)"
    return f"{facts(entity, binding)}, {now}, {old} SELECT n.*, o.previous_rank, o.previous_rank - n.rank AS rank_change, o.previous_rank IS NULL AS is_new FROM now_ n LEFT JOIN old_ o USING (user_id, entity_id)"


def _days(now: str, n: int) -> tuple[str, str]:
    return f"played_at >= {now} - INTERVAL {n} DAY", f"played_at >= {now} - INTERVAL {2 * n} DAY AND played_at < {now} - INTERVAL {n} DAY"


def _label(granularity: str, week_start: str = "monday") -> str:
    shift = {"monday": "", "sunday": " - INTERVAL 1 DAY", "friday": " - INTERVAL 4 DAY"}[week_start]
    fmt = {"day": "%Y-%m-%d", "week": "%Y-W%W", "month": "%Y-%m", "year": "%Y"}[granularity]
    return f"strftime(played_at{shift}, '{fmt}')"


def ranks(entity: str, granularity: str = "week", week_start: str = "monday", metric: str = "total_ms") -> str:
    """CTEs up to ``ranks``: every entity's rank in every period."""
    return f"{facts(entity)}, counts AS (SELECT user_id, {_label(granularity, week_start)} AS period, entity_id, {_COUNTS} FROM facts GROUP BY ALL), ranks AS (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY {metric} DESC, entity_id) AS rank FROM counts)"


def chart(*a: str) -> str:
    return f"{ranks(*a)}, chart AS (SELECT * FROM ranks WHERE rank <= 25)"


_PREV_WEEK = "CASE WHEN substr(period, 7, 2) = '00' THEN CAST(CAST(substr(period, 1, 4) AS INT) - 1 AS VARCHAR) || '-W52' ELSE substr(period, 1, 6) || lpad(CAST(CAST(substr(period, 7, 2) AS INT) - 1 AS VARCHAR), 2, '0') END"
#: what was true of a chart row at its time, by looking back over the entity's rows
_PEAKS = """peaks AS (
  SELECT c.user_id, c.period, c.entity_id, c.play_count, c.total_ms, c.rank, min(b.rank) AS peak_rank, count(*) AS weeks_on_chart,
         arg_min(b.period, (b.rank, b.period)) AS peak_period, list_sort(list(b.period)) AS seen
  FROM chart c JOIN chart b ON b.user_id = c.user_id AND b.entity_id = c.entity_id AND b.period <= c.period GROUP BY ALL),
at_peak AS (SELECT p.user_id, p.period, p.entity_id, count(*) AS times_at_peak, string_agg(b.period, ',' ORDER BY b.period) AS peak_periods
  FROM peaks p JOIN chart b ON b.user_id = p.user_id AND b.entity_id = p.entity_id AND b.period <= p.period AND b.rank = p.peak_rank GROUP BY ALL),
numbered AS (SELECT user_id, period, row_number() OVER (PARTITION BY user_id ORDER BY period) AS i FROM (SELECT DISTINCT user_id, period FROM chart)),
runs AS (SELECT *, row_number() OVER (PARTITION BY user_id, entity_id, island ORDER BY i) AS consecutive FROM (
  SELECT c.user_id, c.period, c.entity_id, n.i, n.i - row_number() OVER (PARTITION BY c.user_id, c.entity_id ORDER BY n.i) AS island FROM chart c JOIN numbered n USING (user_id, period)))"""


def _board(name: str, rows: str, limit: int = 10) -> str:
    return f"SELECT user_id, '{name}' AS board, position, entity_id, value, week FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, entity_id) AS position FROM ({rows})) WHERE position <= {limit}"


_PEAK_WEEK = "SELECT user_id, entity_id, max(total_ms) AS value, arg_max(period, (total_ms, period)) AS week FROM ranks GROUP BY ALL"
_DEBUT = "SELECT user_id, entity_id, arg_min(total_ms, period) AS value, min(period) AS week FROM ranks GROUP BY ALL"
_RUN = """SELECT user_id, entity_id, max(n) AS value, CASE WHEN max(CASE WHEN ends = latest THEN n END) = max(n) THEN 'active' END AS week FROM (
  SELECT user_id, entity_id, island, count(*) AS n, max(period) AS ends, any_value(latest) AS latest FROM (
    SELECT r.user_id, r.entity_id, r.period, w.latest, w.i - row_number() OVER (PARTITION BY r.user_id, r.entity_id ORDER BY w.i) AS island
    FROM ranks r JOIN (SELECT user_id, period, row_number() OVER (PARTITION BY user_id ORDER BY period) AS i, max(period) OVER (PARTITION BY user_id) AS latest FROM (SELECT DISTINCT user_id, period FROM ranks)) w USING (user_id, period)
    WHERE r.rank <= 25) GROUP BY ALL) GROUP BY ALL"""


def _weeks(rank: int) -> str:
    return f"SELECT user_id, entity_id, count(*) AS value, CAST(NULL AS VARCHAR) AS week FROM ranks WHERE rank <= {rank} GROUP BY user_id, entity_id"


def _in_playlists(entity: str) -> str:
    extra = {"track": "", "artist": "JOIN track_artists a ON a.track_id = t.track_id AND a.position = 0", "album": "JOIN tracks a ON a.track_id = t.track_id AND a.album_id IS NOT NULL"}[entity]
    having = "" if entity == "artist" else "HAVING count(DISTINCT t.playlist_id) > 1"
    return f"SELECT p.user_id, {'t' if entity == 'track' else 'a'}.{entity}_id AS entity_id, count(DISTINCT t.playlist_id) AS value, CAST(NULL AS VARCHAR) AS week FROM playlist_tracks t JOIN playlists p USING (playlist_id) {extra} GROUP BY 1, 2 {having}"


def _no1(of: str) -> str:
    credit = "SELECT track_id AS e, artist_id FROM track_artists WHERE position = 0" if of == "track" else "SELECT DISTINCT t.album_id AS e, a.artist_id FROM track_artists a JOIN tracks t USING (track_id) WHERE a.position = 0"
    return f"SELECT r.user_id, c.artist_id AS entity_id, count(DISTINCT r.entity_id) AS value, CAST(NULL AS VARCHAR) AS week FROM ranks r JOIN ({credit}) c ON c.e = r.entity_id WHERE r.rank = 1 GROUP BY 1, 2"


def _records(entity: str, week_start: str = "monday", metric: str = "total_ms") -> str:
    boards = (("peakWeek", _PEAK_WEEK), ("biggestDebut", _DEBUT), ("weeksAtNo1", _weeks(1)), ("weeksInChart", _weeks(25)), ("longestRun", _RUN), ("inMostPlaylists", _in_playlists(entity)))
    parts = [f"({_board(n, q.replace('total_ms', metric))})" for n, q in boards]
    if entity == "artist":
        parts += [f"(SELECT * FROM ({ranks(of)} {_board(f'mostNo1{of.capitalize()}s', _no1(of))}))" for of in ("track", "album")]
    return f"{ranks(entity, 'week', week_start, metric)} " + " UNION ALL ".join(parts)


def _rankings(entity: str, binding: str, now: str, metric: str) -> str:
    value = "1" if metric == "plays" else "duration_ms"
    starts = {"week": f"{now} - INTERVAL 7 DAY", "month": f"{now} - INTERVAL 30 DAY", "this_year": f"date_trunc('year', {now})"}
    sums = ", ".join(f"sum(CASE WHEN played_at >= {s} THEN {value} ELSE 0 END) AS v_{n}" for n, s in starts.items())
    out = ", ".join(f"CASE WHEN v_{n} > 0 THEN rank() OVER (PARTITION BY user_id ORDER BY v_{n} DESC) END AS rank_{n}" for n in starts)
    return f"{facts(entity, binding)}, vals AS (SELECT user_id, entity_id, {sums}, sum({value}) AS v_all FROM facts GROUP BY 1, 2) SELECT user_id, entity_id, {out}, rank() OVER (PARTITION BY user_id ORDER BY v_all DESC) AS rank_all FROM vals"


_STATS = "SELECT user_id, entity_id, count(*) AS play_count, CAST(sum(duration_ms) AS BIGINT) AS total_ms, min(played_at) AS first_played, max(played_at) AS last_played FROM facts GROUP BY 1, 2"
_SERIES = "SELECT user_id, {} AS period, " + _COUNTS + " FROM facts GROUP BY 1, 2"
_LED = "SELECT DISTINCT a.artist_id, t.album_id FROM track_artists a JOIN tracks t USING (track_id) WHERE a.position = 0"


def _candidates(rows: str, order: str) -> str:
    return f"{EVENTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, track_id) AS rank FROM ({rows})) WHERE rank <= 25"


def _found(key: str, hits: str, counts: str) -> str:
    return f"{STAR} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY play_count DESC, {key}) AS rank FROM (SELECT h.*, coalesce(c.n, 0) AS play_count FROM ({hits}) h LEFT JOIN ({counts}) c USING ({key}))) WHERE rank <= 20"


_SCORE = "CASE num % 4 WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 3 END"
_TYPED = "typed AS (SELECT album_id, CAST(substr(album_id, 7, 3) AS BIGINT) AS num FROM albums)"
_TRACK_MAP = """ids AS (SELECT t.track_id, first_value(t.track_id) OVER (PARTITION BY t.track_id % 40, a.artist_id ORDER BY coalesce(s.score, 1), coalesce(c.n, 0) DESC, t.track_id) AS best
  FROM tracks t JOIN (SELECT track_id, min(artist_id) AS artist_id FROM track_artists WHERE position = 0 GROUP BY 1) a USING (track_id)
  LEFT JOIN (SELECT album_id, """ + _SCORE + """ AS score FROM typed) s USING (album_id) LEFT JOIN (SELECT track_id, count(*) AS n FROM plays GROUP BY 1) c ON c.track_id = t.track_id)"""


def _album_map(prefix: str, order: str) -> str:
    return f"""{STAR.replace("WITH ", "WITH RECURSIVE ", 1)}, {_TYPED}, sized AS (SELECT t.album_id, count(*) AS n FROM tracks t GROUP BY 1), led AS ({_LED}),
        m AS (SELECT d.album_id, first_value(d.album_id) OVER (PARTITION BY d.num % 6, l.artist_id ORDER BY {order}, d.album_id) AS best FROM led l JOIN typed d USING (album_id) JOIN sized z USING (album_id)),
        steps AS (SELECT album_id AS a, min(best) AS b FROM m WHERE album_id <> best GROUP BY album_id),
        ends AS (SELECT a, b FROM steps UNION SELECT e.a, s.b FROM ends e JOIN steps s ON s.a = e.b)
        SELECT '{prefix}' || a AS old, '{prefix}' || b AS new FROM ends WHERE b NOT IN (SELECT a FROM steps)"""


def _hex_id(*parts: str) -> str:
    return f"'import:' || substr(sha256({" || '|' || ".join(f'lower({p})' for p in parts)}), 1, 16)"


_ENTRIES = """entries AS (SELECT user_id, event_id AS seq, date_trunc('second', ts) AS at_, k, CASE WHEN k % 10 <> 0 THEN 'Track ' || k END AS track_name, 'Artist ' || (k % 7) AS artist_name, CASE WHEN k % 3 = 0 THEN 'Album ' || (k % 5) END AS album_name, k * 1000 AS ms_played
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
valid AS (SELECT *, CASE WHEN k % 2 = 0 THEN 't' || k ELSE """ + _hex_id("artist_name", "track_name") + """ END AS track_id FROM entries WHERE track_name IS NOT NULL AND ms_played >= 30000),
once AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY user_id, at_ ORDER BY seq) = 1)"""
_SNAPS = "snaps AS (SELECT user_id, ts AS at_, k % 5 <> 0 AS is_playing, CASE WHEN k % 4 = 0 THEN 's' || k ELSE 'local:' || (k % 3) END AS item_id, k * 100 AS progress_ms, k * 1000 + 60000 AS duration_ms FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"
_YEAR, _WEEK = _days(STAR_NOW, 365), _days(EVENTS_NOW, 7)

ORACLES: dict[str, str] = {
    "top_tracks": _top("track", STAR, *_YEAR),
    "top_artists": _top("artist", STAR, *_YEAR, "play_count"),
    "top_albums_merged": _top("album", STAR, *_YEAR),
    "top_tracks_week": _top("track", EVENTS, *_WEEK),
    "top_tracks_this_year": _top("track", STAR, "played_at >= TIMESTAMP '2001-01-01'", "played_at >= TIMESTAMP '2000-01-01' AND played_at < TIMESTAMP '2000-08-02'"),
    "top_tracks_all": _top("track", STAR, "true", None),
    "entity_stats_track": f"{facts('track')} {_STATS}",
    "entity_stats_artist": f"{facts('artist')} {_STATS}",
    "entity_stats_album": f"{facts('album')} {_STATS}",
    "total_stats": f"{facts('track')} SELECT count(*) AS play_count, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms, min(played_at) AS first_played, max(played_at) AS last_played FROM facts",
    "series_day": f"{facts('track', EVENTS)} {_SERIES.format(_label('day'))}",
    "series_week": f"{facts('track')} {_SERIES.format(_label('week'))}",
    "series_month": f"{facts('track')} {_SERIES.format(_label('month'))}",
    "entity_series_auto": f"{facts('artist')} SELECT user_id, {_label('month')} AS period, entity_id, {_COUNTS} FROM facts WHERE {_YEAR[0]} GROUP BY 1, 2, 3",
    "entity_series_week": f"{facts('artist')} SELECT user_id, {_label('week')} AS period, entity_id, {_COUNTS} FROM facts WHERE {_days(STAR_NOW, 180)[0]} GROUP BY 1, 2, 3",
    "recent_plays": f"{EVENTS} SELECT * FROM (SELECT user_id, track_id AS entity_id, row_number() OVER (PARTITION BY user_id, track_id ORDER BY played_at DESC, play_id) AS n, play_id, track_id, played_at FROM plays) WHERE n <= 3",
    "history_page": f"{EVENTS}, found AS (SELECT * FROM plays WHERE user_id = 1 AND track_id IN (SELECT track_id FROM track_artists WHERE artist_id = 1)) SELECT *, (SELECT count(*) FROM found) > 10 AS has_more FROM found ORDER BY played_at DESC, play_id LIMIT 5 OFFSET 5",
    "history_day": f"{EVENTS} SELECT * FROM plays WHERE user_id = 1 AND CAST(played_at AS DATE) = DATE '2024-01-10'",
    "history_total": f"{EVENTS} SELECT count(*) AS total FROM plays WHERE user_id = 1 AND track_id IN (SELECT track_id FROM track_artists WHERE artist_id = 1)",
    "delete_history": f"{EVENTS} SELECT * FROM plays WHERE NOT (user_id = 1 AND play_id < 900 AND play_id % 3 = 0)",
    "rankings_four_ranges": _rankings("track", EVENTS, EVENTS_NOW, "time"),
    "rankings_albums": _rankings("album", STAR, STAR_NOW, "plays"),
    "ranking_history_cumulative": f"""{facts('artist')}, monthly AS (SELECT user_id, {_label('month')} AS period, entity_id, sum(duration_ms) AS v FROM facts GROUP BY 1, 2, 3),
        totals AS (SELECT m.user_id, m.period, e.entity_id, CAST(sum(e.v) AS BIGINT) AS total FROM (SELECT DISTINCT user_id, {_label('month')} AS period FROM plays) m JOIN monthly e ON e.user_id = m.user_id AND e.period <= m.period GROUP BY 1, 2, 3)
        SELECT *, rank() OVER (PARTITION BY user_id, period ORDER BY total DESC) AS rank FROM totals""",
    "artist_top_tracks": f"{STAR} SELECT user_id, artist_id, rank, track_id, play_count, total_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artist_id ORDER BY total_ms DESC, track_id) AS rank FROM (SELECT p.user_id, a.artist_id, p.track_id, {_COUNTS} FROM plays p JOIN tracks USING (track_id) JOIN track_artists a USING (track_id) GROUP BY 1, 2, 3)) WHERE rank <= 10",
    "artist_top_albums": f"""{STAR} SELECT user_id, artist_id, rank, album_id, play_count, total_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artist_id ORDER BY total_ms DESC, album_id) AS rank FROM (
        SELECT p.user_id, a.artist_id, coalesce(m.target_id, t.album_id) AS album_id, {_COUNTS} FROM plays p JOIN tracks t USING (track_id) JOIN track_artists a USING (track_id) LEFT JOIN merge_rules m ON m.user_id = p.user_id AND m.source_id = t.album_id
        WHERE (a.artist_id, t.album_id) IN ({_LED} AND t.album_id IS NOT NULL) GROUP BY 1, 2, 3)) WHERE rank <= 10""",
    "album_tracks": f"{STAR} SELECT t.album_id, t.track_id, t.name, t.duration_ms, coalesce(c.n, 0) AS play_count, coalesce(c.n, 0) * t.duration_ms AS total_ms FROM tracks t LEFT JOIN (SELECT track_id, count(*) AS n FROM plays WHERE user_id = 1 GROUP BY 1) c USING (track_id) WHERE t.album_id IS NOT NULL",
    "album_resolution": f"{facts('album')} SELECT user_id, entity_id AS album_id, count(*) AS play_count FROM facts GROUP BY 1, 2",
    "enrich_track": f"{STAR} SELECT t.track_id, t.name, t.album_id, b.name AS album_name, t.duration_ms, c.artists FROM tracks t LEFT JOIN albums b USING (album_id) LEFT JOIN (SELECT track_id, string_agg(artist_id || ':' || name, '|' ORDER BY position) AS artists FROM track_artists JOIN artists USING (artist_id) GROUP BY 1) c USING (track_id)",
    "track_artists_ordered": f"{STAR} SELECT track_id, position, artist_id, name FROM track_artists JOIN artists USING (artist_id)",
    "track_album_breakdown": f"{STAR} SELECT p.user_id, p.track_id, t.album_id, b.name AS album_name, {_COUNTS} FROM plays p JOIN tracks t USING (track_id) JOIN albums b USING (album_id) GROUP BY 1, 2, 3, 4",
    "lookup_tracks": f"{STAR} SELECT * FROM tracks WHERE track_id IN (1, 17, 42)",
    "week_chart_monday": f"{chart('artist')} SELECT * FROM chart",
    "week_chart_friday": f"{chart('artist', 'week', 'friday')} SELECT * FROM chart",
    "week_chart_sunday": f"{chart('album', 'week', 'sunday', 'play_count')} SELECT * FROM chart",
    "month_chart": f"{chart('track', 'month')} SELECT * FROM chart",
    "year_chart": f"{chart('album', 'year')} SELECT * FROM chart",
    "period_chart": f"{chart('track')} SELECT * FROM chart WHERE period = '1997-W20'",
    "chart_rank_change": f"{chart('artist')}, prev AS (SELECT *, {_PREV_WEEK} AS before FROM chart) SELECT c.user_id, c.period, c.entity_id, c.play_count, c.total_ms, c.rank, b.rank AS previous_rank, b.rank - c.rank AS rank_change FROM prev c LEFT JOIN chart b ON b.user_id = c.user_id AND b.period = c.before AND b.entity_id = c.entity_id",
    "chart_peaks": f"""{chart('artist')}, {_PEAKS}, prev AS (SELECT *, {_PREV_WEEK} AS before FROM peaks)
        SELECT p.user_id, p.period, p.entity_id, p.play_count, p.total_ms, p.rank, p.peak_rank, p.weeks_on_chart, p.peak_period, a.peak_periods, a.times_at_peak, r.consecutive, b.rank AS previous_rank, b.rank - p.rank AS rank_change,
               b.rank IS NULL AND p.weeks_on_chart <= 1 AS is_new, b.rank IS NULL AND p.weeks_on_chart > 1 AS is_reentry
        FROM prev p JOIN at_peak a USING (user_id, period, entity_id) JOIN runs r USING (user_id, period, entity_id) LEFT JOIN chart b ON b.user_id = p.user_id AND b.period = p.before AND b.entity_id = p.entity_id""",
    "chart_consecutive": f"{chart('track', 'month')}, {_PEAKS} SELECT c.user_id, c.period, c.entity_id, c.rank, r.consecutive FROM chart c JOIN runs r USING (user_id, period, entity_id)",
    "chart_dropouts": f"{chart('artist')}, {_PEAKS}, now_ AS (SELECT user_id, period, {_PREV_WEEK} AS before FROM (SELECT DISTINCT user_id, period FROM chart)) SELECT n.user_id, n.period, p.entity_id, p.rank AS previous_rank, p.peak_rank, p.peak_period, p.weeks_on_chart FROM now_ n JOIN peaks p ON p.user_id = n.user_id AND p.period = n.before WHERE NOT EXISTS (SELECT 1 FROM chart c WHERE c.user_id = n.user_id AND c.period = n.period AND c.entity_id = p.entity_id)",
    "chart_periods": f"{STAR} SELECT DISTINCT user_id, {_label('week')} AS period FROM plays",
    "entity_chart_history": f"{chart('artist')}, firsts AS (SELECT user_id, entity_id, min(period) AS f FROM chart GROUP BY 1, 2), all_ AS (SELECT DISTINCT user_id, {_label('week')} AS period FROM plays) SELECT f.user_id, f.entity_id, a.period, c.rank FROM firsts f JOIN all_ a ON a.user_id = f.user_id AND a.period >= f.f LEFT JOIN chart c ON c.user_id = f.user_id AND c.entity_id = f.entity_id AND c.period = a.period",
    "entity_chart_summary": f"""{chart('artist')}, latest AS (SELECT user_id, max({_label('week')}) AS current_period FROM plays GROUP BY 1)
        SELECT c.user_id, c.entity_id, l.current_period, max(CASE WHEN c.period = l.current_period THEN c.rank END) AS current_rank, min(c.rank) AS peak_rank, arg_min(c.period, (c.rank, c.period)) AS peak_period,
               count(*) FILTER (c.rank = (SELECT min(x.rank) FROM chart x WHERE x.user_id = c.user_id AND x.entity_id = c.entity_id)) AS times_at_peak, count(*) AS weeks_on_chart FROM chart c JOIN latest l USING (user_id) GROUP BY 1, 2, 3""",
    "rec_peak_week": f"{ranks('artist')} {_board('peakWeek', _PEAK_WEEK)}",
    "rec_debuts": f"{ranks('artist')} {_board('biggestDebut', _DEBUT)}",
    "rec_weeks_no1": f"{ranks('artist')} {_board('weeksAtNo1', _weeks(1))}",
    "rec_weeks_in_chart": f"{ranks('artist')} {_board('weeksInChart', _weeks(25))}",
    "rec_longest_run": f"{ranks('artist')} {_board('longestRun', _RUN)}",
    "rec_no1_tracks": f"{ranks('track')} {_board('mostNo1Tracks', _no1('track'))}",
    "rec_no1_albums": f"{ranks('album')} {_board('mostNo1Albums', _no1('album'))}",
    "rec_most_playlists": f"{STAR} {_board('inMostPlaylists', _in_playlists('artist'))}",
    "rec_most_playlists_track": f"{STAR} {_board('inMostPlaylists', _in_playlists('track'))}",
    "rec_most_playlists_album": f"{STAR} {_board('inMostPlaylists', _in_playlists('album'))}",
    "records_track": _records("track"),
    "records_album": _records("album", "friday", "play_count"),
    "records_artist": _records("artist"),
    "accolades": f"{ranks('album')} " + " UNION ALL ".join(f"({_board(n, q, 25)})" for n, q in (("peakWeek", _PEAK_WEEK), ("biggestDebut", _DEBUT), ("weeksAtNo1", _weeks(1)), ("weeksInChart", _weeks(25)), ("longestRun", _RUN), ("inMostPlaylists", _in_playlists("album")), ("inPlaylists", _in_playlists("album")))),
    "top_genres": f"{EVENTS} SELECT user_id, genre, play_count, total_ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, genre) AS rank FROM (SELECT user_id, genre, {_COUNTS} FROM (SELECT p.user_id, t.duration_ms, unnest(n.genres) AS genre FROM plays p JOIN tracks t USING (track_id) JOIN track_artists a USING (track_id) JOIN artists n USING (artist_id)) GROUP BY 1, 2)) WHERE rank <= 50",
    "heatmap": f"{EVENTS} SELECT user_id, CAST(dayofweek(played_at) AS INT) AS dow, CAST(hour(played_at) AS INT) AS hour, count(*) AS play_count FROM plays GROUP BY 1, 2, 3",
    "missing_metadata": f"{STAR} SELECT count(*) AS tracks, count(*) FILTER (album_id IS NULL) AS tracks_without_album, count(*) FILTER (popularity IS NULL) AS tracks_without_popularity, (SELECT count(*) FROM artists) AS artists, (SELECT count(*) FROM artists WHERE len(genres) = 0) AS artists_without_genres, (SELECT count(*) FROM albums) AS albums FROM tracks",
    "streaks": f"""{EVENTS}, days AS (SELECT DISTINCT user_id, CAST(played_at AS DATE) AS day FROM plays), runs AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM days) GROUP BY 1, 2)
        SELECT user_id, CAST(sum(n) AS BIGINT) AS days, max(n) AS longest, coalesce(max(CASE WHEN last >= DATE '2024-01-30' THEN n END), 0) AS current FROM runs GROUP BY 1""",
    "search_artists": _found("artist_id", "SELECT artist_id, name FROM artists WHERE lower(strip_accents(name)) LIKE '%0003%'", "SELECT a.artist_id, count(*) AS n FROM plays p JOIN track_artists a USING (track_id) WHERE p.user_id = 1 GROUP BY 1"),
    "search_albums": _found("album_id", "SELECT album_id, name FROM albums WHERE lower(strip_accents(name)) LIKE '%brand#2%' AND album_id NOT IN (SELECT source_id FROM merge_rules WHERE user_id = 1)", "SELECT coalesce(m.target_id, t.album_id) AS album_id, count(*) AS n FROM plays p JOIN tracks t USING (track_id) LEFT JOIN merge_rules m ON m.user_id = p.user_id AND m.source_id = t.album_id WHERE p.user_id = 1 AND t.album_id IS NOT NULL GROUP BY 1"),
    "search_tracks": _found("track_id", "SELECT t.track_id, t.name, n.name AS artist_name FROM tracks t LEFT JOIN (SELECT track_id, min(artist_id) AS artist_id FROM track_artists WHERE position = 0 GROUP BY 1) a USING (track_id) LEFT JOIN artists n USING (artist_id) WHERE lower(strip_accents(t.name)) LIKE '%00_1%' OR lower(strip_accents(n.name)) LIKE '%00_1%'", "SELECT track_id, count(*) AS n FROM plays WHERE user_id = 1 GROUP BY 1"),
    "merge_info": f"{STAR} SELECT r.user_id, r.album_id, r.direction, r.other_id, b.name AS other_name FROM (SELECT user_id, source_id AS album_id, 'into' AS direction, target_id AS other_id FROM merge_rules UNION ALL SELECT user_id, target_id, 'from', source_id FROM merge_rules) r JOIN albums b ON b.album_id = r.other_id",
    "merge_list": f"{STAR} SELECT m.user_id, m.source_id, s.name AS source_name, m.target_id, t.name AS target_name, l.artist_id, n.name AS artist_name FROM merge_rules m LEFT JOIN albums s ON s.album_id = m.source_id LEFT JOIN albums t ON t.album_id = m.target_id LEFT JOIN ({_LED}) l ON l.album_id = m.target_id LEFT JOIN artists n ON n.artist_id = l.artist_id",
    "merge_suggestions": f"{STAR} SELECT l.artist_id, b.album_id, b.name, coalesce(c.n, 0) AS plays FROM ({_LED}) l JOIN albums b USING (album_id) LEFT JOIN (SELECT t.album_id, count(*) AS n FROM plays p JOIN tracks t USING (track_id) WHERE p.user_id = 1 GROUP BY 1) c USING (album_id) WHERE b.album_id NOT IN (SELECT source_id FROM merge_rules WHERE user_id = 1)",
    "library_playlists": f"{EVENTS} SELECT * FROM playlists p WHERE EXISTS (SELECT 1 FROM playlist_tracks t WHERE t.playlist_id = p.playlist_id)",
    "playlist_track_stats": f"{STAR} SELECT t.playlist_id, p.user_id, t.position, t.track_id, coalesce(c.play_count, 0) AS play_count, coalesce(c.total_ms, 0) AS total_ms, c.last_played FROM playlist_tracks t JOIN playlists p USING (playlist_id) LEFT JOIN (SELECT user_id, track_id, {_COUNTS}, max(played_at) AS last_played FROM plays JOIN tracks USING (track_id) GROUP BY 1, 2) c ON c.user_id = p.user_id AND c.track_id = t.track_id",
    "playlist_genres": f"{STAR} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY track_count DESC, genre) AS rank FROM (SELECT playlist_id, genre, count(*) AS track_count FROM (SELECT t.playlist_id, unnest(n.genres) AS genre FROM playlist_tracks t JOIN track_artists a USING (track_id) JOIN artists n USING (artist_id)) GROUP BY 1, 2)) WHERE rank <= 20",
    "playlist_series": f"{STAR} SELECT l.playlist_id, {_label('month')} AS period, {_COUNTS} FROM playlist_tracks m JOIN playlists l USING (playlist_id) JOIN plays p ON p.user_id = l.user_id AND p.track_id = m.track_id JOIN tracks t ON t.track_id = p.track_id GROUP BY 1, 2",
    "playlist_coverage": f"{STAR} SELECT playlist_id, count(*) FILTER (n > 0) AS tracks_played, count(*) AS total_tracks, CAST(sum(n) AS BIGINT) AS total_plays, CAST(sum(n * duration_ms) AS BIGINT) AS total_ms, CAST(floor(100.0 * count(*) FILTER (n > 0) / count(*) + 0.5) AS BIGINT) AS percent FROM (SELECT m.playlist_id, t.duration_ms, coalesce(c.n, 0) AS n FROM playlist_tracks m JOIN playlists l USING (playlist_id) JOIN tracks t USING (track_id) LEFT JOIN (SELECT user_id, track_id, count(*) AS n FROM plays GROUP BY 1, 2) c ON c.user_id = l.user_id AND c.track_id = m.track_id) GROUP BY 1",
    "presence_track": f"{STAR} SELECT DISTINCT p.user_id, t.track_id AS entity_id, p.playlist_id, p.name FROM playlist_tracks t JOIN playlists p USING (playlist_id)",
    "presence_artist": f"{STAR} SELECT DISTINCT p.user_id, a.artist_id AS entity_id, p.playlist_id, p.name FROM playlist_tracks t JOIN playlists p USING (playlist_id) JOIN track_artists a USING (track_id)",
    "presence_album": f"{STAR} SELECT DISTINCT p.user_id, a.album_id AS entity_id, p.playlist_id, p.name FROM playlist_tracks t JOIN playlists p USING (playlist_id) JOIN tracks a USING (track_id) WHERE a.album_id IS NOT NULL",
    "strategy_top_range": _candidates(f"SELECT user_id, track_id, {_COUNTS} FROM plays JOIN tracks USING (track_id) WHERE {_days(EVENTS_NOW, 30)[0]} GROUP BY 1, 2", "total_ms DESC"),
    "strategy_top_artist": _candidates(f"SELECT user_id, track_id, {_COUNTS} FROM plays JOIN tracks USING (track_id) WHERE track_id IN (SELECT track_id FROM track_artists WHERE artist_id = 1) GROUP BY 1, 2", "total_ms DESC"),
    "strategy_top_genre": _candidates(f"SELECT user_id, track_id, {_COUNTS} FROM plays JOIN tracks USING (track_id) JOIN track_artists USING (track_id) JOIN (SELECT artist_id, unnest(genres) AS genre FROM artists) USING (artist_id) WHERE genre = 'ASIA' GROUP BY 1, 2", "total_ms DESC"),
    "strategy_deep_cuts": _candidates("SELECT user_id, track_id, count(*) AS play_count, any_value(popularity) AS popularity FROM plays JOIN tracks USING (track_id) WHERE popularity <= 15 GROUP BY 1, 2 HAVING count(*) >= 2", "popularity, play_count DESC"),
    "strategy_time_vibes": _candidates("SELECT user_id, track_id, count(*) AS play_count FROM plays WHERE dayofweek(played_at) IN (0, 6) AND hour(played_at) IN (20, 21, 22, 23) GROUP BY 1, 2", "play_count DESC"),
    "strategy_rediscovery": _candidates(f"SELECT user_id, track_id, count(*) AS play_count, max(played_at) AS last_played FROM plays GROUP BY 1, 2 HAVING count(*) >= 2 AND max(played_at) < {EVENTS_NOW} - INTERVAL 10 DAY", "play_count DESC"),
    "export_plays": f"{EVENTS} SELECT p.user_id, p.played_at, p.track_id, t.name AS track_name, c.artist_names, b.name AS album_name, t.duration_ms FROM plays p JOIN tracks t USING (track_id) LEFT JOIN albums b USING (album_id) LEFT JOIN (SELECT track_id, string_agg(name, ', ' ORDER BY position) AS artist_names FROM track_artists JOIN artists USING (artist_id) GROUP BY 1) c ON c.track_id = p.track_id",
    "total_plays": f"{EVENTS} SELECT user_id, count(*) AS total FROM plays GROUP BY 1",
    "import_extended": f"WITH {_ENTRIES} SELECT user_id, strftime(at_, '%Y-%m-%d %H:%M:%S') AS played_at, track_id, ms_played FROM once",
    "import_basic": f"WITH e AS (SELECT user_id, event_id AS seq, date_trunc('minute', ts) AS at_, 'Track ' || k AS track_name, 'Artist ' || (k % 7) AS artist_name, k * 1000 AS ms_played FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 30) SELECT user_id, strftime(at_, '%Y-%m-%d %H:%M:%S') AS played_at, {_hex_id('artist_name', 'track_name')} AS track_id, ms_played FROM e QUALIFY row_number() OVER (PARTITION BY user_id, at_ ORDER BY seq) = 1",
    "import_dedupe": f"WITH {_ENTRIES} SELECT e.user_id, 2 * count(*) AS total, any_value(o.n) AS imported, 2 * count(*) - 2 * count(*) FILTER (track_name IS NULL OR ms_played < 30000) - any_value(o.n) AS duplicates, 2 * count(*) FILTER (track_name IS NULL OR ms_played < 30000) AS skipped FROM entries e LEFT JOIN (SELECT u.user_id, count(o.user_id) AS n FROM (SELECT DISTINCT user_id FROM entries) u LEFT JOIN once o USING (user_id) GROUP BY 1) o USING (user_id) GROUP BY 1",
    "import_tracks": f"WITH {_ENTRIES} SELECT track_id, arg_min(track_name, seq) AS name, arg_min(CASE WHEN album_name IS NOT NULL THEN {_hex_id('artist_name', 'album_name')} ELSE '' END, seq) AS a, arg_min(ms_played, seq) AS duration_ms FROM valid GROUP BY 1",
    "stream_dedupe_plays": f"{EVENTS} SELECT DISTINCT ON (user_id, played_at) user_id, strftime(played_at, '%Y-%m-%d %H:%M:%S.%f') AS played_at, track_id FROM plays",
    "local_plays": f"""WITH {_SNAPS}, l AS (SELECT user_id, at_, CASE WHEN is_playing AND item_id LIKE 'local:%' THEN item_id END AS t, progress_ms AS p, duration_ms AS d FROM snaps),
        b AS (SELECT *, lag(t) OVER w AS lt, lag(p) OVER w AS lp FROM l WINDOW w AS (PARTITION BY user_id ORDER BY at_)),
        s AS (SELECT *, sum(CASE WHEN t IS DISTINCT FROM lt OR p < lp THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_) AS run FROM b),
        f AS (SELECT user_id, run, arg_min(t, at_) AS t, min(at_) AS at_, arg_min(d, at_) AS d FROM s WHERE t IS NOT NULL GROUP BY 1, 2)
        SELECT f.user_id, f.t AS track_id, strftime(f.at_, '%Y-%m-%d %H:%M:%S') AS played_at, f.d AS duration_ms FROM f WHERE f.run < (SELECT max(run) FROM s WHERE s.user_id = f.user_id)""",
    "now_playing": f"WITH {_SNAPS} SELECT user_id, strftime(max(at_), '%Y-%m-%d %H:%M:%S') AS \"at\", arg_max(is_playing, at_) AS is_playing, arg_max(item_id, at_) AS item_id, arg_max(progress_ms, at_) AS progress_ms, max(at_) >= TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR AS shown FROM snaps GROUP BY 1",
    "dedup_tracks": f"{EVENTS}, {_TYPED}, {_TRACK_MAP} SELECT track_id AS old, best AS new FROM ids WHERE track_id <> best",
    "dedup_tracks_plays": f"{EVENTS}, {_TYPED}, {_TRACK_MAP} SELECT coalesce(i.best, p.track_id) AS track_id, count(*) AS play_count FROM plays p LEFT JOIN ids i USING (track_id) GROUP BY 1",
    "dedup_albums": _album_map("", f"{_SCORE}, num % 9 DESC"),
    "dedup_local_albums": _album_map("local:", "n DESC"),
    "artist_alias_merge": f"""{STAR}, named AS (SELECT CASE WHEN artist_id % 2 = 0 THEN 'import:' || artist_id ELSE CAST(artist_id AS VARCHAR) END AS id, artist_id, 'artist ' || ((artist_id // 2) % 20) AS low FROM artists),
        reals AS (SELECT low, min(id) AS r FROM named WHERE id NOT LIKE 'import:%' GROUP BY 1)
        SELECT a.track_id, CASE WHEN n.id LIKE 'import:%' THEN coalesce(r.r, n.id) ELSE n.id END AS artist_id, min(a.position) AS position FROM track_artists a JOIN named n USING (artist_id) LEFT JOIN reals r ON r.low = n.low GROUP BY 1, 2""",
    "upsert_tracks": f"""{STAR}, fresh AS (SELECT track_id * 2 AS track_id, name || ' v2' AS name, album_id, duration_ms + 1 AS duration_ms, popularity + 2 AS popularity FROM tracks WHERE track_id % 3 = 0)
        SELECT coalesce(t.track_id, f.track_id) AS track_id, coalesce(f.name, t.name) AS name, CASE WHEN t.track_id IS NOT NULL THEN t.album_id ELSE f.album_id END AS album_id, coalesce(t.duration_ms, f.duration_ms) AS duration_ms, coalesce(f.popularity, t.popularity) AS popularity FROM tracks t FULL JOIN fresh f USING (track_id)""",
}
ORACLES["import_tracks"] = ORACLES["import_tracks"].replace("SELECT track_id, arg_min", "SELECT track_id, name, nullif(a, '') AS album_id, duration_ms FROM (SELECT track_id, arg_min", 1) + ")"

_ASKED = "asked AS (SELECT track_id % 7 AS user_id, coalesce(album_id, 'Nowhere') AS source_id, 'Brand#' || ((track_id // 7) % 26) AS target_id, track_id AS seq FROM tracks)"
#: rules taken one by one: each user's list so far, and the next rule
_ADDED = f"""{STAR.replace("WITH ", "WITH RECURSIVE ", 1)}, {_ASKED},
    queue AS MATERIALIZED (SELECT user_id, source_id, target_id, source_id IN (SELECT album_id FROM albums) AND target_id IN (SELECT album_id FROM albums) AS known, row_number() OVER (PARTITION BY user_id ORDER BY seq, source_id, target_id) AS i FROM asked),
    fold AS (SELECT u.user_id, CAST(0 AS BIGINT) AS i, coalesce(m.rules, []) AS rules FROM (SELECT user_id FROM asked UNION SELECT user_id FROM merge_rules) u LEFT JOIN (SELECT user_id, list({{'s': source_id, 't': target_id}}) AS rules FROM merge_rules GROUP BY 1) m USING (user_id)
      UNION ALL SELECT f.user_id, q.i, CASE WHEN q.known AND q.source_id <> q.target_id AND len(list_filter(f.rules, lambda r: r.s = q.source_id OR r.s = q.target_id OR r.t = q.source_id)) = 0 THEN list_append(f.rules, {{'s': q.source_id, 't': q.target_id}}) ELSE f.rules END
      FROM fold f JOIN queue q ON q.user_id = f.user_id AND q.i = f.i + 1),
    added AS (SELECT user_id, r.s AS source_id, r.t AS target_id FROM (SELECT user_id, unnest(rules) AS r FROM (SELECT user_id, rules FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)))"""


def _by_settings(entity: str) -> str:
    """CTEs up to ``ranks`` by each user's own week and metric; the value is called total_ms."""
    label = "CASE week_start " + " ".join(f"WHEN '{w}' THEN {_label('week', w)}" for w in ("monday", "sunday", "friday")) + " END"
    return f"""{facts(entity)}, own AS (SELECT user_id, CASE WHEN user_id % 4 = 0 OR user_id = 3 THEN 'monday' WHEN user_id % 4 = 1 THEN 'sunday' ELSE 'friday' END AS week_start, user_id % 2 = 0 AS by_plays FROM (SELECT DISTINCT user_id FROM plays)),
        counts AS (SELECT user_id, {label} AS period, entity_id, CAST(CASE WHEN by_plays THEN count(*) ELSE sum(duration_ms) END AS BIGINT) AS total_ms FROM facts JOIN own USING (user_id) GROUP BY 1, 2, 3, by_plays),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY total_ms DESC, entity_id) AS rank FROM counts)"""


def _boards_by_settings() -> str:
    parts = []
    for entity in ("track", "album", "artist"):
        boards = (("peakWeek", _PEAK_WEEK), ("biggestDebut", _DEBUT), ("weeksAtNo1", _weeks(1)), ("weeksInChart", _weeks(25)), ("longestRun", _RUN), ("inMostPlaylists", _in_playlists(entity)))
        one = [f"({_board(n, q)})" for n, q in boards]
        if entity == "artist":
            one += [f"(SELECT * FROM ({_by_settings(of)} {_board(f'mostNo1{of.capitalize()}s', _no1(of))}))" for of in ("track", "album")]
        parts.append(f"SELECT user_id, '{entity}' AS entity, board, position, CAST(entity_id AS VARCHAR) AS entity_id, value, week FROM ({_by_settings(entity)} {' UNION ALL '.join(one)})")
    return " UNION ALL ".join(parts)


_COVERED = f"""{STAR}, numbered AS (SELECT album_id, CAST(substr(album_id, 7, 3) AS INT) AS n FROM albums),
    covered AS (SELECT CASE WHEN n % 3 = 0 THEN 'import:' WHEN n % 5 = 0 THEN 'local:' ELSE '' END || album_id AS album_id, n % 3 = 0 OR n % 5 = 0 AS own, 'Name ' || (n % 4) AS name, CASE WHEN n % 7 = 0 THEN '' WHEN n % 4 = 0 THEN 'old' END AS image_url FROM numbered)"""


def _accolades(entity: str, week_start: str = "monday", metric: str = "total_ms") -> str:
    boards = (("peakWeek", _PEAK_WEEK), ("biggestDebut", _DEBUT), ("weeksAtNo1", _weeks(1)), ("weeksInChart", _weeks(25)), ("longestRun", _RUN), ("inMostPlaylists", _in_playlists(entity)), ("inPlaylists", _in_playlists(entity)))
    parts = [f"({_board(n, q.replace('total_ms', metric), 25)})" for n, q in boards]
    if entity == "artist":
        parts += [f"(SELECT * FROM ({ranks(of)} {_board(f'mostNo1{of.capitalize()}s', _no1(of), 25)}))" for of in ("track", "album")]
    return f"{ranks(entity, 'week', week_start, metric)} " + " UNION ALL ".join(parts)


_CUSTOM = "played_at >= TIMESTAMP '2024-01-12' AND played_at <= TIMESTAMP '2024-01-18 23:59:59.999'"


def _custom(start: str, end: str) -> tuple[str, str]:
    """Predicates of the closed range of whole days, and of the half-open one of equal length before it."""
    a, b = f"TIMESTAMP '{start}'", f"TIMESTAMP '{end} 23:59:59.999'"
    return f"played_at >= {a} AND played_at <= {b}", f"played_at >= {a} - ({b} - {a}) AND played_at < {a}"


ORACLES |= {
    "period_chart_entries": f"SELECT * FROM ({ORACLES['chart_peaks']}) WHERE period = '1997-W20'",
    "period_chart_dropouts": f"{chart('artist')}, {_PEAKS} SELECT p.user_id, p.entity_id, p.rank AS previous_rank, p.peak_rank, p.peak_period, p.weeks_on_chart FROM peaks p WHERE p.period = '1997-W19' AND NOT EXISTS (SELECT 1 FROM chart c WHERE c.user_id = p.user_id AND c.period = '1997-W20' AND c.entity_id = p.entity_id)",
    "stream_local_plays": ORACLES["local_plays"],
    "merge_problems": f"""{STAR}, {_ASKED}, rules AS (SELECT user_id, source_id, target_id FROM asked) SELECT DISTINCT user_id, source_id, target_id, problem FROM (
        SELECT r.*, 'self' AS problem FROM rules r WHERE source_id = target_id
        UNION ALL SELECT user_id, source_id, target_id, 'duplicate' FROM rules GROUP BY 1, 2, 3 HAVING count(*) >= 2
        UNION ALL SELECT r.*, 'reverse' FROM rules r JOIN rules o ON o.user_id = r.user_id AND o.source_id = r.target_id AND o.target_id = r.source_id WHERE r.source_id <> r.target_id
        UNION ALL SELECT r.*, 'chain' FROM rules r JOIN rules o ON o.user_id = r.user_id AND (o.source_id = r.target_id OR o.target_id = r.source_id) WHERE r.source_id <> r.target_id
        UNION ALL SELECT r.*, 'two_targets' FROM rules r JOIN rules o ON o.user_id = r.user_id AND o.source_id = r.source_id AND o.target_id <> r.target_id)""",
    "merge_rules_added": f"{_ADDED} SELECT * FROM added",
    "merge_rules_deleted": f"{_ADDED} SELECT * FROM added WHERE user_id <> 1",
    "album_ids_resolved": f"{_ADDED} SELECT user_id, target_id AS album_id, target_id AS member_id FROM added UNION SELECT user_id, target_id, source_id FROM added",
    "album_artists": f"""{STAR}, two AS (SELECT track_id, track_id // 2 AS i, 'P' || (track_id // 2) AS album_id FROM tracks),
        stored AS (SELECT album_id, unnest([i % 5 + 1, i % 5 + 2]) AS artist_id, CAST(NULL AS BIGINT) AS track_count FROM (SELECT DISTINCT album_id, i FROM two WHERE i % 3 = 0)),
        led AS (SELECT t.album_id, a.artist_id, count(DISTINCT t.track_id) AS track_count FROM two t JOIN track_artists a USING (track_id) WHERE a.position = 0 AND t.i % 3 <> 0 GROUP BY 1, 2)
        SELECT r.album_id, r.artist_id, n.name, r.track_count FROM (SELECT * FROM stored UNION ALL SELECT * FROM led) r JOIN artists n USING (artist_id)""",
    "playlists_synced": f"""{STAR}, feed AS (SELECT p.playlist_id, p.user_id, 'v' || (p.playlist_id % 3) AS snapshot_id FROM playlists p WHERE p.playlist_id % 4 <> 0),
        tracks_ AS (SELECT t.playlist_id, t.track_id + (CASE WHEN t.playlist_id % 3 <> 0 THEN 1 ELSE 0 END) AS track_id FROM playlist_tracks t JOIN feed USING (playlist_id)
          UNION ALL SELECT t.playlist_id, t.track_id FROM playlist_tracks t JOIN playlists p USING (playlist_id) WHERE p.user_id NOT IN (SELECT user_id FROM feed))
        SELECT playlist_id, track_id, count(*) OVER (PARTITION BY playlist_id) AS tracks, CAST(sum(track_id) OVER (PARTITION BY playlist_id) AS BIGINT) AS ids FROM tracks_""",
    "albums_inserted": "SELECT DISTINCT p_brand AS album_id, p_brand AS name FROM part UNION ALL SELECT 'New#' || i, 'first' FROM range(3) t(i)",
    "settings_merged": "SELECT user_id, key, value FROM (SELECT user_id, 'sort' AS key, arg_max(CASE WHEN event_id % 2 = 0 THEN 'plays' ELSE 'time' END, event_id) AS value FROM events GROUP BY 1) UNION ALL SELECT DISTINCT user_id, 'language', 'en' FROM events",
    "artists_enriched": "SELECT s_suppkey AS artist_id, CASE WHEN s_suppkey % 3 = 0 THEN 'old' WHEN s_suppkey % 2 = 0 THEN 'img' || s_suppkey END AS image_url FROM supplier",
    "credits_fixed": f"""{STAR} SELECT track_id, artist_id FROM (SELECT CAST(track_id AS VARCHAR) AS track_id, CASE WHEN artist_id % 3 = 0 THEN 'import:' ELSE '' END || artist_id AS artist_id, track_id % 2 AS odd FROM track_artists) WHERE odd = 1 OR NOT starts_with(artist_id, 'import:')
        UNION SELECT CAST(track_id AS VARCHAR), CAST(artist_id + 1 AS VARCHAR) FROM track_artists WHERE track_id % 2 = 0""",
    "generated_playlists": f"SELECT user_id, track_id, position FROM (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('17:' || user_id || ':' || track_id), track_id) - 1 AS position FROM ({ORACLES['strategy_rediscovery']})) WHERE position < 10",
    "search_accents": _found("artist_id", "SELECT artist_id, name FROM artists WHERE lower(strip_accents(name)) LIKE '%supplier#00000000_%'", "SELECT a.artist_id, count(*) AS n FROM plays p JOIN track_artists a USING (track_id) WHERE p.user_id = 1 GROUP BY 1"),
}

ORACLES |= {
    "top_tracks_custom": _top("track", EVENTS, *_custom("2024-01-12", "2024-01-18")),
    "top_albums_custom": _top("album", STAR, *_custom("1997-03-01", "1997-05-31"), "play_count"),
    "genres_custom": ORACLES["top_genres"].replace("JOIN artists n USING (artist_id))", f"JOIN artists n USING (artist_id) WHERE {_CUSTOM})"),
    "entity_series_custom": f"{facts('artist', EVENTS)} {_SERIES.format('entity_id, ' + _label('day')).replace('FROM facts', f'FROM facts WHERE {_CUSTOM}').replace('GROUP BY 1, 2', 'GROUP BY 1, 2, 3')}",
    "entity_series_one_day": f"{facts('artist', EVENTS)} {_SERIES.format('entity_id, ' + _label('month')).replace('FROM facts', 'FROM facts WHERE CAST(played_at AS DATE) = DATE \'2024-01-12\'').replace('GROUP BY 1, 2', 'GROUP BY 1, 2, 3')}",
    "strategy_top_range_custom": _candidates(f"SELECT user_id, track_id, {_COUNTS} FROM plays JOIN tracks USING (track_id) WHERE {_CUSTOM} GROUP BY 1, 2", "total_ms DESC"),
    "strategy_top_artist_custom": ORACLES["strategy_top_artist"].replace("WHERE track_id IN", f"WHERE {_CUSTOM} AND track_id IN"),
    "strategy_top_genre_custom": ORACLES["strategy_top_genre"].replace("WHERE genre", f"WHERE {_CUSTOM} AND genre"),
    "strategy_deep_cuts_custom": ORACLES["strategy_deep_cuts"].replace("WHERE popularity", f"WHERE {_CUSTOM} AND popularity").replace("HAVING count(*) >= 2", ""),
    "strategy_time_vibes_custom": ORACLES["strategy_time_vibes"].replace("WHERE dayofweek", f"WHERE {_CUSTOM} AND dayofweek"),
    "records_by_settings": _boards_by_settings(),
    "partial_top_artists": ORACLES["top_artists"],
    "partial_week_chart": ORACLES["week_chart_friday"],
    "partial_series_week": ORACLES["series_week"],
    "partial_ranking_history": ORACLES["ranking_history_cumulative"],
    "partial_records": ORACLES["records_track"],
    "stream_partial_rankings": ORACLES["rankings_four_ranges"],
    "chart_history_from_changes": ORACLES["entity_chart_history"],
    "chart_history_part": f"SELECT * FROM ({ORACLES['entity_chart_history']}) WHERE period BETWEEN '1997-W10' AND '1997-W30'",
    "ranking_history_from_changes": ORACLES["ranking_history_cumulative"],
    "upsert_tracks_buckets": ORACLES["upsert_tracks"],
    "history_page_keyset": f"{EVENTS}, found AS (SELECT * FROM plays WHERE played_at < TIMESTAMP '2024-01-20' OR (played_at = TIMESTAMP '2024-01-20' AND play_id > 0)) SELECT *, (SELECT count(*) FROM found) > 20 AS has_more FROM found ORDER BY played_at DESC, play_id LIMIT 20",
    "stream_timed_plays": f"""WITH {_SNAPS}, l AS (SELECT user_id, at_, CASE WHEN is_playing AND item_id LIKE 'local:%' THEN item_id END AS t, progress_ms AS p, duration_ms AS d FROM snaps),
        b AS (SELECT *, lag(t) OVER w AS lt, lag(p) OVER w AS lp, lag(at_) OVER w AS lat FROM l WINDOW w AS (PARTITION BY user_id ORDER BY at_)),
        s AS (SELECT *, sum(CASE WHEN t IS DISTINCT FROM lt OR p < lp OR at_ - lat > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_) AS run FROM b),
        f AS (SELECT user_id, run, arg_min(t, at_) AS t, min(at_) AS at_, max(at_) AS seen, arg_min(d, at_) AS d FROM s WHERE t IS NOT NULL GROUP BY 1, 2)
        SELECT f.user_id, f.t AS track_id, strftime(f.at_, '%Y-%m-%d %H:%M:%S') AS played_at, f.d AS duration_ms FROM f WHERE f.run < (SELECT max(run) FROM s WHERE s.user_id = f.user_id) OR f.seen + INTERVAL 6 HOUR < (SELECT max(at_) FROM l) - INTERVAL 1 MINUTE""",
    "local_ids": f"""{STAR}, e AS (SELECT track_id AS entry, CASE WHEN track_id % 11 <> 0 THEN upper(name) END AS track_name, CASE WHEN track_id % 13 <> 0 THEN 'SUPPLIER ' || (track_id % 50) ELSE 'Unknown Artist' END AS artist_name, CASE WHEN track_id % 17 <> 0 THEN 'Record ' || (track_id % 30) ELSE 'Unknown Album' END AS album_name FROM tracks),
        a AS (SELECT 'supplier ' || (artist_id % 40) AS k, min('a' || artist_id) AS id FROM artists GROUP BY 1), b AS (SELECT 'record ' || substr(album_id, 7, 3) AS k, min('local:' || album_id) AS id FROM albums WHERE CAST(substr(album_id, 7, 3) AS INT) % 2 = 0 GROUP BY 1),
        t AS (SELECT lower(name) AS k, 'local:Brand#' || (track_id % 30) AS album_id, min('local:t' || track_id) AS id FROM tracks WHERE track_id % 4 = 0 GROUP BY 1, 2),
        r AS (SELECT e.*, coalesce(a.id, 'local:' || substr(sha256(concat_ws('|', lower(artist_name), lower(artist_name))), 1, 16)) AS artist_id, coalesce(b.id, 'local:' || substr(sha256(concat_ws('|', lower(artist_name), lower(album_name))), 1, 16)) AS album_id
              FROM e LEFT JOIN a ON a.k = lower(e.artist_name) LEFT JOIN b ON b.k = lower(e.album_name))
        SELECT r.entry, r.artist_id, r.album_id, coalesce(t.id, 'local:' || substr(sha256(concat_ws('|', lower(artist_name), lower(track_name))), 1, 16)) AS track_id FROM r LEFT JOIN t ON t.k = lower(r.track_name) AND t.album_id = r.album_id""",
    "album_aliases": f"{_COVERED} SELECT c.album_id AS old, r.id AS new FROM covered c JOIN (SELECT name, min(album_id) AS id FROM covered WHERE NOT own GROUP BY 1) r USING (name) WHERE c.own",
    "covers_missing": f"{_COVERED} SELECT album_id, name, image_url FROM covered WHERE own AND image_url IS NULL",
    "covers_found": f"{_COVERED} SELECT album_id, name, CASE WHEN own AND image_url IS NULL THEN CASE WHEN length(album_id) % 2 = 0 THEN 'img of ' || name ELSE '' END ELSE image_url END AS image_url FROM covered",
    "covers_added": f"""{STAR}, seen AS (SELECT album_id, 'c' || (track_id % 3) AS image_url, track_id FROM tracks WHERE album_id IS NOT NULL), old AS (SELECT DISTINCT album_id, image_url FROM seen WHERE track_id % 5 = 0)
        SELECT album_id, image_url, 'old' AS source, CAST(0 AS BIGINT) AS observed_at FROM old UNION ALL SELECT album_id, image_url, 'track', min(track_id) FROM seen WHERE (album_id, image_url) NOT IN (SELECT album_id, image_url FROM old) GROUP BY 1, 2""",
    "accolades_track": _accolades("track", "friday", "play_count"),
    "accolades_artist": _accolades("artist"),
    "search_index_artists": ORACLES["search_artists"],
    "search_index_albums": ORACLES["search_albums"],
    "search_index_tracks": ORACLES["search_tracks"],
    "import_files": "SELECT number, CASE number % 5 WHEN 3 THEN 'error' WHEN 4 THEN 'skipped' ELSE 'read' END AS status, CASE WHEN number % 5 < 3 THEN n ELSE 0 END AS entries FROM (SELECT event_id // 100 AS number, count(*) AS n FROM events GROUP BY 1)",
    "import_files_plays": f"WITH {_ENTRIES}, read_ AS (SELECT * FROM valid WHERE seq // 100 % 5 < 3 QUALIFY row_number() OVER (PARTITION BY at_ ORDER BY seq) = 1) SELECT CAST(1 AS BIGINT) AS user_id, strftime(at_, '%Y-%m-%d %H:%M:%S') AS played_at, track_id, ms_played FROM read_",
    "export_csv": ORACLES["export_plays"],
    "export_json": ORACLES["export_plays"],
    "playlist_pages": f"{STAR} SELECT playlist_id, track_id, position FROM playlist_tracks",
    "series_day_stored": ORACLES["series_day"],
    "month_chart_stored": f"{facts('track', EVENTS)}, counts AS (SELECT user_id, {_label('month')} AS period, entity_id, {_COUNTS} FROM facts WHERE played_at >= TIMESTAMP '2024-01-01' AND played_at < TIMESTAMP '2024-02-01' GROUP BY ALL), ranks AS (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY total_ms DESC, entity_id) AS rank FROM counts) SELECT * FROM ranks WHERE rank <= 25",
}
