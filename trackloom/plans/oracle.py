"""The queries in DuckDB's SQL, from the same ``events`` table."""

from __future__ import annotations

_TRK = """
ev AS (SELECT value, event_type, CAST(floor(event_id / 23) AS BIGINT) AS frame_id, event_id % 23 AS slot FROM events),
hf AS (SELECT (max(frame_id) + 1) // 2 AS half FROM ev),
ld AS (SELECT *, CASE WHEN slot = 22 THEN 0 ELSE slot % 11 END AS k, CASE WHEN frame_id < half THEN 1 ELSE 2 END AS period,
  CAST(frame_id - CASE WHEN frame_id < half THEN 0 ELSE half END AS DOUBLE) / 25.0::DOUBLE AS timestamp,
  CASE WHEN slot = 22 THEN 'ball' WHEN slot < 11 THEN 'home' ELSE 'away' END AS team FROM ev, hf),
pl AS (SELECT *, CASE WHEN team = 'home' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS d, (value - floor(value) - 0.5::DOUBLE) * 0.06::DOUBLE AS nz,
  CASE WHEN k = 0 THEN 0.25::DOUBLE ELSE 3.0::DOUBLE + 0.55::DOUBLE * k END AS v FROM ld
  WHERE NOT ((team = 'away' AND k > 0 AND event_type = 'error') OR (team = 'home' AND k = 5 AND frame_id % 120 BETWEEN 60 AND 92))),
trk AS (SELECT 'events' AS match_id, CAST(period AS TINYINT) AS period, frame_id, timestamp,
  CASE WHEN slot = 22 THEN 'ball' ELSE team[1] || '_' || k END AS track_id, team,
  CAST(CASE WHEN slot <> 22 AND k % 4 <> 3 THEN k + 1 END AS SMALLINT) AS jersey_number,
  CASE WHEN slot = 22 THEN abs((timestamp * 6.0::DOUBLE) % 80.0::DOUBLE - 40.0::DOUBLE) - 20.0::DOUBLE WHEN k = 0 THEN d * -48.0::DOUBLE + nz
    ELSE d * (abs((timestamp * v + 3.0::DOUBLE * k) % 80.0::DOUBLE - 40.0::DOUBLE) - 28.0::DOUBLE) + nz END AS x_pitch,
  CASE WHEN slot = 22 OR k = 0 THEN nz ELSE d * (-30.0::DOUBLE + 5.5::DOUBLE * k) + nz + CASE WHEN event_type = 'signup' AND value > 200 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END END AS y_pitch,
  slot = 22 AS is_ball, k = 0 AND slot <> 22 AS is_gk, CASE WHEN frame_id % 50 >= 42 THEN 'dead' ELSE 'alive' END AS ball_state FROM pl)"""

_SEG = """
s0 AS (SELECT *, timestamp - lag(timestamp) OVER w AS step_s, x_pitch - lag(x_pitch) OVER w AS dx, y_pitch - lag(y_pitch) OVER w AS dy
  FROM trk WHERE NOT is_ball WINDOW w AS (PARTITION BY match_id, period, track_id ORDER BY timestamp, frame_id)),
s1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS jump, coalesce(sqrt(dx * dx + dy * dy) > 12.0::DOUBLE * step_s AND step_s <= 1.0::DOUBLE, false) AS impossible FROM s0),
seg AS (SELECT *, step_s IS NULL OR step_s > 1.0::DOUBLE OR impossible AS breaks,
  impossible AND coalesce(lead(impossible) OVER w, false) AS glitch,
  CAST(sum(CAST(step_s IS NULL OR step_s > 1.0::DOUBLE OR impossible AS INT)) OVER w AS BIGINT) AS seg
  FROM s1 WINDOW w AS (PARTITION BY match_id, period, track_id ORDER BY timestamp, frame_id))"""

_GRID = """
g0 AS (SELECT *, row_number() OVER (p ORDER BY timestamp, frame_id) - 1 AS i, count(*) OVER p AS n, min(timestamp) OVER p AS t0, max(timestamp) OVER p AS tn
  FROM seg WHERE NOT glitch WINDOW p AS (PARTITION BY match_id, period, track_id, seg)),
g1 AS (SELECT *, CAST(round_even((tn - t0) / 0.04::DOUBLE, 0) AS BIGINT) + 1 AS n_grid FROM g0),
smp AS (SELECT *, n_grid = n AND max(abs(timestamp - (t0 + i * 0.04::DOUBLE))) OVER (PARTITION BY match_id, period, track_id, seg) <= 0.04::DOUBLE * 1e-3 AS regular FROM g1),
g2 AS (SELECT *, CASE WHEN regular THEN i ELSE CAST(ceil((timestamp - t0) / 0.04::DOUBLE - 1e-6) AS BIGINT) END AS a FROM smp),
g3 AS (SELECT *, lead(timestamp) OVER w AS nt, lead(x_pitch) OVER w AS nx, lead(y_pitch) OVER w AS ny, lead(a) OVER w AS na FROM g2
  WINDOW w AS (PARTITION BY match_id, period, track_id, seg ORDER BY timestamp, frame_id)),
g4 AS (SELECT *, unnest(range(a, coalesce(na, n_grid))) AS g FROM g3),
g5 AS (SELECT *, least(greatest(CASE WHEN regular OR nt IS NULL THEN 0.0::DOUBLE ELSE (t0 + g * 0.04::DOUBLE - timestamp) / (nt - timestamp) END, 0.0::DOUBLE), 1.0::DOUBLE) AS part FROM g4),
grid AS (SELECT match_id, period, track_id, seg, g, n_grid, x_pitch + (coalesce(nx, x_pitch) - x_pitch) * part AS gx, y_pitch + (coalesce(ny, y_pitch) - y_pitch) * part AS gy FROM g5)"""


def _kin(window: int = 21, order: int = 2) -> str:
    half = window // 2
    key = "PARTITION BY match_id, period, track_id, seg"
    powers = {p: sum(k**p for k in range(-half, half + 1)) for p in (2, 4, 6)}
    bend = powers[4] / powers[2]  # what a cubic takes from the line
    cubic = [k / powers[2] - bend * (k**3 - bend * k) / (powers[6] - powers[4] * bend) for k in range(1, half + 1)]

    def fit(c: str, where: str) -> str:
        k = f"k{where}"
        total = lambda x: f"sum(CASE WHEN abs({k}) <= m THEN {x} ELSE 0 END) OVER p"
        a1 = f"{total(f'{k} * {c}')} / s2"
        if order == 3:
            a2 = f"{total(f'({k} * {k} - s2 / (2 * m + 1)) * {c}')} / (s4 - s2 * s2 / (2 * m + 1))"
            a3 = f"{total(f'({k} * {k} * {k} - s4 / s2 * {k}) * {c}')} / (s6 - s4 * s4 / s2)"
            return f"({a1} + 2 * ({a2}) * {k} + ({a3}) * (3 * {k} * {k} - s4 / s2)) / 0.04::DOUBLE"
        a2 = f"((2 * m + 1) * {total(f'{k} * {k} * {c}')} - s2 * {total(c)}) / ((2 * m + 1) * s4 - s2 * s2)"
        return f"({a1} + 2 * ({a2}) * {k}) / 0.04::DOUBLE"

    def derivative(c: str) -> str:
        inner = " + ".join(f"{k}.0::DOUBLE * (lead({c}, {k}) OVER o - lag({c}, {k}) OVER o)" for k in range(1, half + 1))
        s2 = half * (half + 1) * (2 * half + 1) / 3
        short = ""
        if order == 3:
            inner = " + ".join(f"CAST({w!r} AS DOUBLE) * (lead({c}, {k}) OVER o - lag({c}, {k}) OVER o)" for k, w in enumerate(cubic, 1))
            s2 = 1.0  # the weights are whole already
            short = f" WHEN n_grid < 5 THEN coalesce((lead({c}) OVER o - lag({c}) OVER o) / 0.08::DOUBLE, (lead({c}) OVER o - {c}) / 0.04::DOUBLE, ({c} - lag({c}) OVER o) / 0.04::DOUBLE)"
        pair = f"coalesce((lead({c}) OVER o - {c}) / 0.04::DOUBLE, ({c} - lag({c}) OVER o) / 0.04::DOUBLE, 0.0::DOUBLE)"
        return (
            f"CASE WHEN n_grid = 1 THEN 0.0::DOUBLE WHEN n_grid = 2 THEN {pair}{short} WHEN n_grid >= {window} AND g BETWEEN {half} AND n_grid - 1 - {half} THEN ({inner}) / CAST({s2 / 25.0!r} AS DOUBLE) "
            f"WHEN CASE WHEN n_grid >= {window} THEN g < {half} ELSE g <= m END THEN {fit(c, 'h')} ELSE {fit(c, 't')} END"
        )

    return f"""
k0 AS (SELECT *, CAST(greatest(least({half}, (n_grid - 1) // 2), 1) AS DOUBLE) AS m FROM grid),
k1 AS (SELECT *, m * (m + 1) * (2 * m + 1) / 3 AS s2, g - m AS kh, g - (n_grid - 1 - m) AS kt FROM k0),
k2 AS (SELECT *, s2 * (3 * m * m + 3 * m - 1) / 5 AS s4, s2 * (3 * m * m * m * m + 6 * m * m * m - 3 * m + 1) / 7 AS s6 FROM k1),
k3 AS (SELECT match_id, period, track_id, seg, g, {derivative('gx')} AS gvx, {derivative('gy')} AS gvy FROM k2 WINDOW o AS ({key} ORDER BY g), p AS ({key})),
k4 AS (SELECT *, coalesce(lead(gvx) OVER o, gvx) AS nvx, coalesce(lead(gvy) OVER o, gvy) AS nvy FROM k3 WINDOW o AS ({key} ORDER BY g)),
k5 AS (SELECT *, CASE WHEN regular THEN CAST(i AS DOUBLE) ELSE least((timestamp - t0) / 0.04::DOUBLE, CAST(n_grid - 1 AS DOUBLE)) END AS p FROM smp),
k6 AS (SELECT k5.match_id, k5.period, k5.track_id, k5.frame_id, gvx + (nvx - gvx) * (p - floor(p)) AS vx, gvy + (nvy - gvy) * (p - floor(p)) AS vy
  FROM k5 JOIN k4 ON k4.match_id = k5.match_id AND k4.period = k5.period AND k4.track_id = k5.track_id AND k4.seg = k5.seg AND k4.g = CAST(floor(p) AS BIGINT)),
k7 AS (SELECT seg.*, vx AS vx0, vy AS vy0, round(sqrt(vx * vx + vy * vy), 9) AS raw_speed FROM seg LEFT JOIN k6 USING (match_id, period, track_id, frame_id)),
kin AS (SELECT *, CASE WHEN raw_speed > 12 THEN 12.0::DOUBLE ELSE raw_speed END AS speed, vx0 * CASE WHEN raw_speed > 12.0::DOUBLE THEN 12.0::DOUBLE / raw_speed ELSE 1.0::DOUBLE END AS vx,
  vy0 * CASE WHEN raw_speed > 12.0::DOUBLE THEN 12.0::DOUBLE / raw_speed ELSE 1.0::DOUBLE END AS vy,
  CASE WHEN glitch THEN NULL WHEN breaks THEN 0.0::DOUBLE ELSE CASE WHEN raw_speed > 12 THEN 12.0::DOUBLE ELSE raw_speed END * step_s END AS step_dist FROM k7)"""


_THIN = """
fr AS (SELECT match_id, period, frame_id, row_number() OVER (PARTITION BY match_id, period ORDER BY frame_id) - 1 AS r FROM (SELECT DISTINCT match_id, period, frame_id FROM trk WHERE NOT is_ball)),
thin AS (SELECT trk.* FROM trk SEMI JOIN (SELECT * FROM fr WHERE r % 5 = 0) f USING (match_id, period, frame_id))"""


def _cov(rows: str, name: str) -> str:
    return f"""
{name}p AS (SELECT o.match_id, o.period, track_id, team, n_frames, n_total, n_frames * 100.0::DOUBLE / n_total AS coverage_pct
  FROM (SELECT match_id, period, track_id, team, count(DISTINCT frame_id) AS n_frames FROM {rows} WHERE NOT is_ball GROUP BY ALL) o
  JOIN (SELECT match_id, period, count(DISTINCT frame_id) AS n_total FROM {rows} WHERE NOT is_ball GROUP BY ALL) f ON o.match_id = f.match_id AND o.period = f.period),
{name}m AS (SELECT match_id, track_id, team, CAST(sum(n_frames) AS DOUBLE) * 100.0::DOUBLE / any_value(t) AS coverage_pct FROM {name}p
  JOIN (SELECT match_id, CAST(sum(n_total) AS BIGINT) AS t FROM (SELECT DISTINCT match_id, period, n_total FROM {name}p) GROUP BY ALL) USING (match_id) GROUP BY ALL)"""


def _efforts(name: str = "eff", limit: str = "7.0::DOUBLE", rows: str = "kin", extra: str = "") -> str:
    key = f"{extra}match_id, period, track_id"
    return f"""
{name}0 AS (SELECT {key}, team, timestamp, frame_id, coalesce(speed, 0.0::DOUBLE) AS sp, coalesce(step_dist, 0.0::DOUBLE) AS st, coalesce(speed, 0.0::DOUBLE) >= {limit} AS fast,
  row_number() OVER (PARTITION BY {key} ORDER BY timestamp, frame_id) AS rn FROM {rows}),
{name}1 AS (SELECT *, rn - lag(rn) OVER (PARTITION BY {key} ORDER BY rn) - 1 AS gap FROM {name}0 WHERE fast),
{name}2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY rn) AS e FROM {name}1),
{name}3 AS (SELECT {key}, e, min(rn) AS a, max(rn) AS b FROM {name}2 GROUP BY ALL),
{name} AS (SELECT {', '.join('r.' + c for c in key.split(', '))}, arg_min(team, rn) AS team, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) / 25.0::DOUBLE AS duration_s, max(sp) AS peak_speed_mps,
  avg(sp) AS mean_speed_mps, sum(st) AS distance_m FROM {name}0 r JOIN {name}3 x ON {' AND '.join(f'r.{c} = x.{c}' for c in key.split(', '))} AND rn BETWEEN a AND b GROUP BY {', '.join('r.' + c for c in key.split(', '))}, e
  HAVING count(*) / 25.0::DOUBLE >= 1.0)"""


_TABLE = """
ph0 AS (SELECT match_id, track_id, team, sum(coalesce(step_dist, 0)) AS d, sum(CASE WHEN coalesce(speed, 0) >= 5.5 THEN coalesce(step_dist, 0) ELSE 0 END) AS h, max(speed) AS top FROM kin GROUP BY ALL),
ph1 AS (SELECT ph0.*, coalesce(n, 0) AS n, coalesce(coverage_pct, 0) AS coverage_pct FROM ph0 LEFT JOIN (SELECT match_id, track_id, team, count(*) AS n FROM eff GROUP BY ALL) USING (match_id, track_id, team) LEFT JOIN ctm USING (match_id, track_id, team)),
phy AS (SELECT match_id, track_id, team, top AS top_speed_mps, CASE WHEN coverage_pct >= 95 THEN d END AS distance_m, CASE WHEN coverage_pct >= 95 THEN h END AS hsr_distance_m, CASE WHEN coverage_pct >= 95 THEN n END AS n_sprints,
  coverage_pct, coverage_pct < 95 AS below_coverage FROM ph1)"""

_FULL = """
fm0 AS (SELECT match_id, period, min(frame_id) AS lo, max(frame_id) AS hi FROM trk WHERE NOT is_ball GROUP BY ALL),
fm1 AS (SELECT match_id, track_id FROM (SELECT trk.match_id, track_id, count(DISTINCT (trk.period, trk.frame_id)) AS n FROM trk JOIN fm0 ON trk.match_id = fm0.match_id AND trk.period = fm0.period AND frame_id IN (lo, hi) WHERE NOT is_ball GROUP BY ALL)
  JOIN (SELECT match_id, CAST(sum(CASE WHEN lo = hi THEN 1 ELSE 2 END) AS BIGINT) AS k FROM fm0 GROUP BY ALL) USING (match_id) WHERE n = k)"""

_DIR = """
dr0 AS (SELECT match_id, period, team, coalesce(avg(x_pitch) FILTER (is_gk), avg(x_pitch) FILTER (NOT is_gk)) AS ref FROM trk WHERE NOT is_ball GROUP BY ALL),
dir AS (SELECT match_id, period, team, CAST(CASE WHEN CASE WHEN count(*) OVER p = 2 THEN row_number() OVER (p ORDER BY ref, team) = 1 ELSE ref <= 0 END THEN 1 ELSE -1 END AS INT) AS direction FROM dr0 WINDOW p AS (PARTITION BY match_id, period))"""

_OUT = """
ofd AS (SELECT match_id, period, frame_id, timestamp, team, track_id, x_pitch AS x, y_pitch AS y, ball_state FROM trk WHERE NOT is_ball AND NOT is_gk)"""

_SHAPE = """
op AS (SELECT DISTINCT match_id, period, frame_id, team, x, y FROM ofd WHERE ball_state = 'alive'),
he AS (SELECT a.match_id, a.period, a.frame_id, a.team, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM op a JOIN op b USING (match_id, period, frame_id, team) WHERE a.x <> b.x OR a.y <> b.y),
hb AS (SELECT DISTINCT he.* FROM he JOIN op c USING (match_id, period, frame_id, team) WHERE (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0
  OR ((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND (c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - by_) > 0)),
hl AS (SELECT match_id, period, frame_id, team, sum(ax * by_ - bx * ay) / 2 AS area FROM (SELECT * FROM he EXCEPT SELECT * FROM hb) GROUP BY ALL),
shp AS (SELECT o.match_id, o.period, o.frame_id, o.timestamp, o.team, list_avg(list_sort(list(x * direction))[1:4]) AS line_height_m, max(y) - min(y) AS width_m, max(x) - min(x) AS length_m,
  avg(x) AS cx_m, avg(y) AS cy_m, count(*) AS n_outfield, CASE WHEN any_value(area) > 1e-9 AND count(DISTINCT (x, y)) >= 3 THEN any_value(area) END AS hull_area_m2, count(*) < 8 AS low_outfield_count
  FROM ofd o JOIN dir ON o.match_id = dir.match_id AND o.period = dir.period AND o.team = dir.team LEFT JOIN hl ON o.match_id = hl.match_id AND o.period = hl.period AND o.frame_id = hl.frame_id AND o.team = hl.team
  WHERE ball_state = 'alive' GROUP BY ALL)"""

_PRESS = """
pb AS (SELECT p.match_id, p.period, p.frame_id, p.timestamp, p.track_id, p.team, p.is_gk, p.x_pitch AS x, p.y_pitch AS y, b.x_pitch AS ball_x, b.y_pitch AS ball_y
  FROM trk p LEFT JOIN (SELECT * FROM trk WHERE is_ball) b ON p.match_id = b.match_id AND p.period = b.period AND p.frame_id = b.frame_id WHERE NOT p.is_ball AND p.ball_state = 'alive'),
cr0 AS (SELECT *, sqrt((x - ball_x) * (x - ball_x) + (y - ball_y) * (y - ball_y)) AS d FROM pb WHERE NOT is_gk AND ball_x IS NOT NULL),
cr1 AS (SELECT * FROM cr0 QUALIFY row_number() OVER (PARTITION BY match_id, period, frame_id ORDER BY d, track_id) = 1),
car AS (SELECT f.match_id, f.period, f.frame_id, f.timestamp, track_id AS carrier_track_id, c.team AS carrier_team, d AS ball_to_carrier_m, x AS cx, y AS cy
  FROM (SELECT DISTINCT match_id, period, frame_id, timestamp FROM trk WHERE ball_state = 'alive') f LEFT JOIN (SELECT * FROM cr1 WHERE d <= 3) c ON f.match_id = c.match_id AND f.period = c.period AND f.frame_id = c.frame_id),
prs AS (SELECT c.match_id, c.period, c.frame_id, c.timestamp, carrier_track_id, carrier_team, ball_to_carrier_m, CASE WHEN carrier_team IS NOT NULL THEN CAST(count_if(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= 5) AS BIGINT) END AS n_pressers,
  min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS nearest_opponent_m FROM car c LEFT JOIN pb ON c.match_id = pb.match_id AND c.period = pb.period AND c.frame_id = pb.frame_id AND pb.team <> c.carrier_team
  GROUP BY c.match_id, c.period, c.frame_id, c.timestamp, carrier_track_id, carrier_team, ball_to_carrier_m)"""

def _area(rows: str, name: str = "ar") -> str:
    """Cells by the crossings of half-plane borders that no other half-plane excludes, around their site."""
    key = "match_id, period, frame_id, sx, sy"
    return f"""
{name}0 AS (SELECT match_id, period, frame_id, timestamp, track_id, team, round(least(greatest(x_pitch, -52.499::DOUBLE), 52.499::DOUBLE), 6) AS sx, round(least(greatest(y_pitch, -33.999::DOUBLE), 33.999::DOUBLE), 6) AS sy FROM {rows}),
{name}1 AS (SELECT {key}, count(*) AS times FROM {name}0 GROUP BY ALL),
{name}2 AS (SELECT s.match_id, s.period, s.frame_id, s.sx, s.sy, o.sx - s.sx AS a, o.sy - s.sy AS b, (o.sx * o.sx + o.sy * o.sy - s.sx * s.sx - s.sy * s.sy) / 2 AS c FROM {name}1 s JOIN {name}1 o USING (match_id, period, frame_id) WHERE o.sx <> s.sx OR o.sy <> s.sy
  UNION ALL SELECT {key}, e.a, e.b, e.c FROM {name}1, (VALUES (1.0::DOUBLE, 0.0::DOUBLE, 52.5::DOUBLE), (-1.0::DOUBLE, 0.0::DOUBLE, 52.5::DOUBLE), (0.0::DOUBLE, 1.0::DOUBLE, 34.0::DOUBLE), (0.0::DOUBLE, -1.0::DOUBLE, 34.0::DOUBLE)) e(a, b, c)),
{name}3 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY a, b, c) AS r FROM {name}2),
{name}4 AS (SELECT {key}, (p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b) AS x, (p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b) AS y FROM {name}3 p JOIN {name}3 q USING ({key}) WHERE p.r < q.r AND abs(p.a * q.b - q.a * p.b) > 1e-9),
{name}5 AS (SELECT {key}, x, y FROM {name}4 v JOIN {name}2 h USING ({key}) GROUP BY ALL HAVING bool_and(a * x + b * y <= c + 1e-7)),
{name}6 AS (SELECT {key}, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {name}5 WINDOW w AS (PARTITION BY {key} ORDER BY atan2(y - sy, x - sx))),
{name}7 AS (SELECT {key}, abs(sum(x * ny - nx * y)) / 2 AS area FROM {name}6 GROUP BY ALL),
{name} AS (SELECT p.match_id, p.period, p.frame_id, timestamp, track_id, team, area / times AS area_m2 FROM {name}0 p JOIN {name}1 s USING ({key}) JOIN {name}7 c USING ({key}))"""


_K = "match_id, period, track_id, frame_id"
_T = "match_id, period, frame_id, team"
_ZONES = [(0, 2), (2, 4), (4, 5.5), (5.5, 7), (7, 99)]


def _zones(keys: str, where: str, speed: str, last_open: bool, zones: list = _ZONES) -> str:
    parts, last = [], len(zones) - 1
    for i, (a, b) in enumerate(zones):
        label = f"{a:g}+" if last_open and i == last else f"{a:g}-{b:g}"
        inside = f"{speed} >= {a}" if i == last else f"{speed} < {b}" if i == 0 else f"{speed} >= {a} AND {speed} < {b}"
        parts.append(f"SELECT {keys}, '{label}' AS zone, CAST({i} AS INT) AS zone_no, sum(CASE WHEN {inside} THEN coalesce(step_dist, 0) ELSE 0 END) AS distance_m FROM kin {where} GROUP BY {keys}")
    return " UNION ALL ".join(parts)


def _checks() -> str:
    from .queries import BANDS

    values = {"distance_km": "distance_m / 1000", "top_speed_mps": "top", "hsr_share_pct": "CASE WHEN distance_m <> 0 THEN hsr_distance_m / distance_m * 100 END", "n_sprints": "CAST(n_sprints AS DOUBLE)"}
    rows = " UNION ALL ".join(f"SELECT match_id, track_id, team, '{k}' AS \"check\", {values[k]} AS value, {BANDS[k][0]}::DOUBLE AS low, {BANDS[k][1]}::DOUBLE AS high FROM w SEMI JOIN fm1 USING (match_id, track_id) ANTI JOIN gks USING (match_id, track_id)" for k in values)
    rows += f" UNION ALL SELECT match_id, track_id, team, 'gk_top_speed_mps', top, NULL, {BANDS['top_speed_mps'][1]}::DOUBLE FROM w SEMI JOIN gks USING (match_id, track_id) WHERE top IS NOT NULL"
    rows += f" UNION ALL SELECT match_id, NULL, team, 'hull_median_m2', median(hull_area_m2), {BANDS['hull_median_m2'][0]}::DOUBLE, {BANDS['hull_median_m2'][1]}::DOUBLE FROM shp WHERE NOT low_outfield_count GROUP BY match_id, team"
    return f"""gks AS (SELECT DISTINCT match_id, track_id FROM trk WHERE is_gk),
w AS (SELECT phy.* REPLACE (phy.top_speed_mps AS top_speed_mps), top_speed_mps AS top FROM phy WHERE NOT below_coverage),
chk AS (SELECT *, coalesce(value IS NOT NULL AND (low IS NULL OR value >= low) AND (high IS NULL OR value <= high), false) AS passed,
  CASE WHEN "check" LIKE '%top_speed_mps' AND value IS NOT NULL THEN abs(value - 12) <= 1.2e-8 END AS at_clip_ceiling FROM ({rows}))"""


def _grid_sql(rows: str, window: str = "") -> str:
    extra, select = (f"{window}, ", f"{window}, ") if window else ("", "")
    return (
        f"th AS (SELECT unnest([6.5, 7.0, 7.5, 8.0])::DOUBLE AS threshold), kt AS (SELECT th.threshold, r.* FROM {rows} r, th),"
        + _efforts("ge", "threshold", "kt", f"{extra}threshold, ")
        + f", gc AS (SELECT {select}t.threshold, t.match_id, t.track_id, count(e.start_ts) AS k FROM (SELECT DISTINCT {select}threshold, match_id, track_id FROM kt) t LEFT JOIN ge e USING ({extra}threshold, match_id, track_id) GROUP BY ALL),"
        f" sg AS (SELECT match_id, {select}threshold, CAST(sum(k) AS BIGINT) AS total_sprints, avg(k) AS sprints_per_player_mean FROM gc GROUP BY ALL)"
    )


def _swept() -> str:
    """Kinematics for each window, one after the other."""
    from ..operators.reports import WINDOWS

    parts = []
    for w in WINDOWS:
        text = _kin(w)
        for name in ("k0", "k1", "k2", "k3", "k4", "k5", "k6", "k7", "kin"):
            text = text.replace(f"\n{name} AS", f"\n{name}_{w} AS").replace(f"FROM {name} ", f"FROM {name}_{w} ").replace(f"FROM {name})", f"FROM {name}_{w})").replace(f"JOIN {name} ", f"JOIN {name}_{w} {name} " if name == "k4" else f"JOIN {name}_{w} ")
        parts.append(text.replace(f"FROM k5_{w} JOIN", f"FROM k5_{w} k5 JOIN"))
    return ",".join(parts) + ",\nswp AS (" + " UNION ALL ".join(f'SELECT CAST({w} AS INT) AS "window", match_id, period, track_id, team, timestamp, frame_id, speed, step_dist FROM kin_{w}' for w in WINDOWS) + ")"


def _entries() -> dict[str, tuple[list[str], str, str]]:
    """name: tables needed, SQL, columns to round."""
    trk, seg, kin = [_TRK], [_TRK, _SEG], [_TRK, _SEG, _GRID, _kin()]
    elapsed = "SELECT f.match_id, f.period, frame_id, timestamp + coalesce(b, 0) AS elapsed_s FROM (SELECT DISTINCT match_id, period, frame_id, timestamp FROM trk) f JOIN (SELECT match_id, period, sum(l) OVER (PARTITION BY match_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT match_id, period, max(timestamp) + median(s) AS l FROM (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY match_id, period ORDER BY timestamp) AS s FROM (SELECT DISTINCT match_id, period, frame_id, timestamp FROM trk)) GROUP BY ALL)) h ON f.match_id = h.match_id AND f.period = h.period"
    two = [_TRK.replace("trk AS", "trk1 AS"), "\ntrk AS (SELECT * FROM trk1 UNION ALL SELECT * REPLACE ('again' AS match_id, -x_pitch AS x_pitch) FROM trk1 WHERE frame_id >= 7)"]
    shape_, press, phys = [_TRK, _OUT, _DIR, _SHAPE], [_TRK, _PRESS], [*kin, _THIN, _cov("thin", "ct"), _efforts(), _TABLE]
    alive_thin = [_TRK, _THIN, _cov("trk", "cf"), _cov("thin", "ct")]
    all_ = "match_id, period, frame_id, timestamp, track_id, team, jersey_number, x_pitch, y_pitch, is_ball, is_gk, ball_state"
    sprint = "match_id, period, track_id, team, start_ts, end_ts, duration_s, peak_speed_mps, mean_speed_mps, distance_m"
    spaces = [_TRK, _area("trk WHERE NOT is_ball AND ball_state = 'alive'")]
    one = [_TRK, "\nnf AS (SELECT match_id, period, arg_min(frame_id, (abs(timestamp - 1.0::DOUBLE), frame_id)) AS frame_id FROM trk WHERE period = 1 GROUP BY ALL)", _area("trk SEMI JOIN nf USING (match_id, period, frame_id) WHERE NOT is_ball AND NOT is_gk")]
    swept = [*seg, _GRID, _FULL, _swept(), _grid_sql("swp", '"window"')]
    dist = "SELECT match_id, \"window\", avg(d) AS mean_distance_m, avg(h) AS mean_hsr_m FROM (SELECT \"window\", match_id, track_id, sum(coalesce(step_dist, 0)) AS d, sum(CASE WHEN coalesce(speed, 0) >= 5.5 THEN coalesce(step_dist, 0) ELSE 0 END) AS h FROM swp SEMI JOIN fm1 USING (match_id, track_id) WHERE track_id NOT IN (SELECT track_id FROM trk WHERE is_gk) GROUP BY ALL) GROUP BY ALL"
    spread = lambda v, rows, at: f"(SELECT (max({v}) - min({v})) / max({v}) FILTER ({at})::DOUBLE * 100 FROM {rows})"
    mid = "\"window\" = 21 AND threshold = 7.0"
    shown = "CASE WHEN below_coverage THEN 'n/a (low coverage)' WHEN distance_m IS NULL THEN '—' ELSE format('{:,}', CAST(round_even(distance_m, 0) AS BIGINT)) || ' (' || CAST(round_even(c.coverage_pct, 0) AS BIGINT) || '% cov)' END"
    return {
        "scan_tracking": (trk, f"SELECT {all_} FROM trk", "timestamp x_pitch y_pitch"),
        "empty_canonical": (trk, f"SELECT {all_} FROM trk WHERE false", "timestamp x_pitch y_pitch"),
        "coerce_types": (trk, f"SELECT {all_} FROM (SELECT * REPLACE (CASE WHEN frame_id % 9 > 0 THEN frame_id END AS frame_id, CASE WHEN NOT is_gk THEN x_pitch END AS x_pitch) FROM trk)", "timestamp x_pitch y_pitch"),
        "validate_counts": (trk, "SELECT count(*) AS n_rows, 0::BIGINT AS bad_team, 0::BIGINT AS bad_ball_state, 0::BIGINT AS nulls, count_if(period NOT IN (1, 2))::BIGINT AS bad_period, count_if(abs(x_pitch * 1.25::DOUBLE) > 57.5 OR abs(y_pitch) > 39)::BIGINT AS off_pitch, count_if(is_ball <> (team = 'ball'))::BIGINT AS ball_mismatch, count_if(is_gk AND is_ball)::BIGINT AS keeper_ball, coalesce(bool_and(x_pitch * 1.25 BETWEEN 0 AND 1), false) AS normalised FROM trk", ""),
        "dup_keys": (trk, "SELECT count(*) AS duplicates FROM trk WHERE frame_id % 7 = 0", ""),
        "monotonic_violations": (trk, "SELECT match_id, period, count_if(f < p)::BIGINT AS violations FROM (SELECT *, lag(f) OVER (PARTITION BY match_id, period ORDER BY timestamp, f) AS p FROM (SELECT DISTINCT match_id, period, timestamp, CASE WHEN frame_id % 50 = 0 THEN frame_id + 2 ELSE frame_id END AS f FROM trk)) GROUP BY ALL", ""),
        "drop_off_pitch": (trk, f"SELECT {_K}, x_pitch * 1.25::DOUBLE AS x_pitch FROM trk WHERE abs(x_pitch * 1.25::DOUBLE) <= 57.5 AND abs(y_pitch) <= 39", "x_pitch"),
        "outfield_rows": ([_TRK, _OUT], "SELECT match_id, period, frame_id, timestamp, team, track_id, x, y FROM ofd", "timestamp x y"),
        "alive_frames": (trk, "SELECT DISTINCT match_id, period, frame_id FROM trk WHERE ball_state = 'alive'", ""),
        "derive_ball_state": (trk, "SELECT match_id, period, frame_id, CASE WHEN abs(x_pitch * 3.0::DOUBLE) <= 52.5 AND abs(y_pitch) <= 34 THEN 'alive' ELSE 'dead' END AS state FROM trk WHERE is_ball", ""),
        "infer_gk": (trk, "SELECT match_id, period, team, arg_min(track_id, (side * x, track_id)) AS track_id FROM (SELECT *, CASE WHEN avg(x) OVER (PARTITION BY match_id, period, team) < 0 THEN 1.0 ELSE -1.0 END AS side FROM (SELECT *, max(n) OVER (PARTITION BY match_id, period, team) AS most FROM (SELECT match_id, period, team, track_id, avg(x_pitch) AS x, count(*) AS n FROM trk WHERE NOT is_ball GROUP BY ALL)) WHERE n >= 0.1 * most) GROUP BY ALL", ""),
        "wide_to_long": (trk, "SELECT match_id, period, frame_id, track_id, x_pitch AS x, y_pitch AS y FROM trk", "x y"),
        "detected_pairs": (trk, "SELECT match_id, period, frame_id, track_id FROM trk WHERE (frame_id + coalesce(jersey_number, 0)) % 4 <> 0 AND frame_id % 11 > 0", ""),
        "keep_detected": (trk, f"SELECT {_K} FROM trk WHERE (frame_id + coalesce(jersey_number, 0)) % 4 <> 0 AND frame_id % 11 > 0", ""),
        "match_meta": (trk, "SELECT match_id, round(1.0 / median(s), 6) AS frame_rate, count(DISTINCT period) AS n_periods, count(*) AS n_frames FROM (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY match_id, period ORDER BY timestamp) AS s FROM (SELECT DISTINCT match_id, period, frame_id, timestamp FROM trk)) GROUP BY ALL", "frame_rate"),
        "downsample": ([_TRK, _THIN], f"SELECT {_K} FROM thin", ""),
        "goalkeeper_ids": (trk, "SELECT DISTINCT match_id, track_id FROM trk WHERE is_gk", ""),
        "full_match_tracks": ([_TRK, _FULL], "SELECT match_id, track_id FROM fm1", ""),
        "outfield_full_match": ([_TRK, _FULL], "SELECT match_id, track_id FROM fm1 EXCEPT SELECT match_id, track_id FROM trk WHERE is_gk", ""),
        "elapsed_time": (trk, elapsed, "elapsed_s"),
        "elapsed_label": ([*trk, f"\nel AS ({elapsed})"], "SELECT match_id, period, frame_id, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS label FROM (SELECT *, floor(round(elapsed_s * 7, 3))::BIGINT AS s FROM el)", ""),
        "window_slice": (trk, f"SELECT {_K} FROM trk WHERE timestamp BETWEEN 1.0 AND 3.0", ""),
        "gap_breaks": (trk, "SELECT match_id, period, track_id, timestamp, x_pitch FROM trk UNION ALL SELECT match_id, period, track_id, (p + timestamp) / 2, NULL FROM (SELECT *, lag(timestamp) OVER (PARTITION BY match_id, period, track_id ORDER BY timestamp) AS p FROM trk) WHERE timestamp - p > 1.0", "timestamp x_pitch"),
        "period_ranges": (trk, "SELECT match_id, period, min(timestamp) AS start_s, max(timestamp) AS end_s FROM trk GROUP BY ALL", "start_s end_s"),
        "nearest_frame": (trk, "SELECT match_id, period, arg_min(frame_id, (abs(timestamp - 2.019::DOUBLE), frame_id)) AS frame_id FROM trk WHERE period = 1 GROUP BY ALL", ""),
        "nearest_frame_rows": (trk, f"SELECT {_K}, x_pitch, y_pitch FROM trk SEMI JOIN (SELECT match_id, period, arg_min(frame_id, (abs(timestamp - 3.33::DOUBLE), frame_id)) AS frame_id FROM trk WHERE period = 2 GROUP BY ALL) USING (match_id, period, frame_id)", "x_pitch y_pitch"),
        "match_summary": (trk, "SELECT match_id, count(*) AS n_rows, count(DISTINCT track_id) FILTER (NOT is_ball) AS n_tracks FROM trk GROUP BY ALL", ""),
        "join_players_ball": (press, "SELECT * FROM pb", "timestamp x y ball_x ball_y"),
        "ball_carrier": (press, "SELECT match_id, period, frame_id, timestamp, carrier_track_id, carrier_team, ball_to_carrier_m FROM car", "timestamp ball_to_carrier_m"),
        "pressing": (press, "SELECT * FROM prs", "timestamp ball_to_carrier_m nearest_opponent_m"),
        "pressing_summary": (press, "SELECT match_id, carrier_team AS team, count(*) AS n_frames, avg(n_pressers) AS mean_pressers, avg(CASE WHEN n_pressers >= 2 THEN 1.0 ELSE 0.0 END) AS several_share FROM prs WHERE n_pressers IS NOT NULL GROUP BY ALL", "mean_pressers several_share"),
        "carrier_left": (press, "SELECT f.match_id, f.period, f.frame_id, f.timestamp, track_id AS carrier_track_id, c.team AS carrier_team, d AS ball_to_carrier_m, x AS carrier_x, y AS carrier_y FROM (SELECT DISTINCT match_id, period, frame_id, timestamp FROM trk WHERE ball_state = 'alive') f LEFT JOIN (SELECT * FROM cr1 WHERE d <= 1.5) c ON f.match_id = c.match_id AND f.period = c.period AND f.frame_id = c.frame_id", "timestamp ball_to_carrier_m carrier_x carrier_y"),
        "pressure_pairs": (press, "SELECT c.match_id, c.period, c.frame_id, carrier_track_id, carrier_team, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS distance_m FROM car c JOIN pb ON c.match_id = pb.match_id AND c.period = pb.period AND c.frame_id = pb.frame_id AND pb.team <> c.carrier_team", "distance_m"),
        "pressure_count": (press, "SELECT match_id, period, frame_id, CAST((SELECT count(*) FROM pb o WHERE o.match_id = c.match_id AND o.period = c.period AND o.frame_id = c.frame_id AND o.team <> c.team AND sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)) <= 8) AS BIGINT) AS n_pressers FROM cr1 c WHERE d <= 5", ""),
        "attacking_direction": ([_TRK, _DIR], "SELECT * FROM dir", ""),
        "direction_lookup": (trk, "SELECT DISTINCT match_id, period, team, CAST(CASE WHEN team = 'home' AND period = 1 THEN 1 ELSE -1 END AS INT) AS direction FROM trk WHERE NOT is_ball", ""),
        "line_height": (shape_, "SELECT match_id, period, frame_id, timestamp, team, line_height_m FROM shp", "timestamp line_height_m"),
        "team_width": (shape_, f"SELECT {_T}, width_m FROM shp", "width_m"),
        "team_length": (shape_, f"SELECT {_T}, length_m FROM shp", "length_m"),
        "team_centroid": (shape_, f"SELECT {_T}, cx_m, cy_m FROM shp", "cx_m cy_m"),
        "hull_area": (shape_, f"SELECT {_T}, hull_area_m2 FROM shp", "hull_area_m2"),
        "team_shape": (shape_, "SELECT * FROM shp", "timestamp line_height_m width_m length_m cx_m cy_m hull_area_m2"),
        "compactness_median": (shape_, "SELECT match_id, team, median(hull_area_m2) AS hull_median_m2 FROM shp WHERE NOT low_outfield_count GROUP BY ALL", "hull_median_m2"),
        "coverage_by_period": (alive_thin, "SELECT match_id, track_id, team, period, n_frames, n_total, coverage_pct FROM cfp", "coverage_pct"),
        "coverage_by_match": (alive_thin, "SELECT * FROM cfm", "coverage_pct"),
        "coverage_summary": (alive_thin, "SELECT match_id, count(*) AS n_tracks, avg(coverage_pct) AS mean_pct, min(coverage_pct) AS min_pct FROM cfm GROUP BY ALL", "mean_pct min_pct"),
        "coverage_union": (alive_thin, "SELECT *, 'full' AS rate FROM cfm UNION ALL SELECT *, 'thin' FROM ctm", "coverage_pct"),
        "coverage_ranked": (alive_thin, "SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY coverage_pct DESC, track_id) AS INT) AS place, avg(coverage_pct) OVER (PARTITION BY match_id) AS mean_pct FROM cfm", "coverage_pct mean_pct"),
        "coverage_full_outer": (alive_thin, "SELECT match_id, track_id, team, t.coverage_pct AS thin_pct, f.coverage_pct FROM ctm t FULL JOIN (SELECT * FROM cfm WHERE track_id <> 'h_1') f USING (match_id, track_id, team)", "thin_pct coverage_pct"),
        "subtracks": (seg, f"SELECT {_K}, seg, breaks FROM seg", ""),
        "glitch_steps": (seg, f"SELECT {_K}, jump, step_s, glitch FROM seg WHERE impossible", "jump step_s"),
        "resample_uniform": ([*seg, _GRID], "SELECT match_id, period, track_id, seg, g, gx, gy FROM grid", "gx gy"),
        "savgol_velocity": (kin, f"SELECT {_K}, raw_speed FROM kin", "raw_speed"),
        "speed_clip": (kin, f"SELECT {_K}, vx, vy, speed FROM kin", "vx vy speed"),
        "step_distance": (kin, f"SELECT {_K}, step_dist FROM kin", "step_dist"),
        "kinematics": (kin, f"SELECT {_K}, vx, vy, speed, step_dist, glitch FROM kin UNION ALL SELECT {_K}, NULL, NULL, NULL, NULL, NULL FROM trk WHERE is_ball", "vx vy speed step_dist"),
        "clip_report": (kin, "SELECT match_id, count_if(raw_speed > 12)::BIGINT AS n_clipped, count(*) AS n_total, count_if(raw_speed > 12) / count(*)::DOUBLE AS clipped_share, max(raw_speed) AS max_raw_speed, count_if(impossible)::BIGINT AS glitch_steps, count_if(glitch)::BIGINT AS glitch_frames FROM kin GROUP BY ALL", "clipped_share max_raw_speed"),
        "kinematics_cubic": ([_TRK, _SEG, _GRID, _kin(order=3)], f"SELECT {_K}, vx, vy, raw_speed FROM kin", "vx vy raw_speed"),
        "kinematics_two_matches": ([*two, _SEG, _GRID, _kin()], f"SELECT {_K}, speed FROM kin", "speed"),
        "thinned_two_matches": ([*two, _THIN], f"SELECT {_K} FROM thin", ""),
        "glitch_report": (seg, "SELECT match_id, team, count_if(impossible)::BIGINT AS glitch_steps, count_if(glitch)::BIGINT AS glitch_frames FROM seg GROUP BY ALL", ""),
        "total_distance": (kin, "SELECT match_id, track_id, sum(step_dist) AS distance_m FROM kin WHERE step_dist IS NOT NULL GROUP BY ALL", "distance_m"),
        "total_distance_by_period": (kin, "SELECT match_id, period, track_id, sum(step_dist) AS distance_m FROM kin WHERE step_dist IS NOT NULL GROUP BY ALL", "distance_m"),
        "distance_by_zone_closed": (kin, _zones("match_id, track_id", "WHERE step_dist IS NOT NULL", "speed", False), "distance_m"),
        "speed_zones": (kin, _zones("match_id, track_id, team", "", "coalesce(speed, 0)", True), "distance_m"),
        "zone_cross_fill": (kin, _zones("match_id, track_id, team", "", "coalesce(speed, 0)", True, [(0, 3), (3, 6), (6, 11), (11, 99)]), "distance_m"),
        "distance_covered": (kin, "SELECT match_id, track_id, team, period, sum(coalesce(step_dist, 0)) AS distance_m FROM kin GROUP BY GROUPING SETS ((match_id, track_id, team, period), (match_id, track_id, team))", "distance_m"),
        "high_speed_running": (kin, "SELECT match_id, track_id, team, sum(CASE WHEN coalesce(speed, 0) >= 5.5 THEN coalesce(step_dist, 0) ELSE 0 END) AS hsr_distance_m FROM kin GROUP BY ALL", "hsr_distance_m"),
        "top_speed": (kin, "SELECT match_id, track_id, team, max(speed) AS top_speed_mps FROM kin GROUP BY ALL", "top_speed_mps"),
        "sprints": ([*kin, _efforts()], f"SELECT {sprint} FROM eff", "start_ts end_ts duration_s peak_speed_mps mean_speed_mps distance_m"),
        "sprint_counts": ([*kin, _efforts()], "SELECT match_id, track_id, team, count(*) AS n_sprints, sum(distance_m) AS sprint_distance_m FROM eff GROUP BY ALL", "sprint_distance_m"),
        "sprint_grid": ([*kin, _grid_sql("kin")], "SELECT * FROM sg", "sprints_per_player_mean threshold"),
        "sprint_spread": ([*kin, _grid_sql("kin")], "SELECT match_id, (max(total_sprints) - min(total_sprints)) / max(total_sprints) FILTER (threshold = 7.0)::DOUBLE * 100 AS spread_pct FROM sg GROUP BY ALL", "spread_pct"),
        "physical_table": (phys, "SELECT * FROM phy", "distance_m hsr_distance_m coverage_pct top_speed_mps"),
        "physical_join": (phys, "SELECT match_id, track_id, team, coverage_pct, coverage_pct < 80 AS below_coverage, CASE WHEN coverage_pct >= 80 THEN d END AS distance_m, CASE WHEN coverage_pct >= 80 THEN h END AS hsr_distance_m, CASE WHEN coverage_pct >= 80 THEN n END AS n_sprints FROM ph1", "distance_m hsr_distance_m coverage_pct"),
        "hsr_share": (phys, "SELECT match_id, track_id, team, CASE WHEN distance_m <> 0 THEN hsr_distance_m / distance_m * 100 END AS hsr_share_pct FROM phy", "hsr_share_pct"),
        "player_table": (phys, f"SELECT match_id, track_id, team, c.coverage_pct, {shown} AS distance_text FROM ctm c FULL JOIN phy USING (match_id, track_id, team)", "coverage_pct"),
        "range_checks": ([*phys, _FULL, _OUT, _DIR, _SHAPE, _checks()], "SELECT * FROM chk", "value low high"),
        "range_excluded": ([*phys, _FULL], "SELECT match_id, unnest(['distance_km', 'top_speed_mps', 'hsr_share_pct', 'n_sprints']) AS \"check\", n_tracks, n_tracks || ' of the full-match tracks have under 95% coverage and no physical values' AS reason FROM (SELECT match_id, count(*) AS n_tracks FROM phy SEMI JOIN fm1 USING (match_id, track_id) WHERE below_coverage GROUP BY ALL)", ""),
        "check_summary": ([*phys, _FULL, _OUT, _DIR, _SHAPE, _checks()], "SELECT \"check\", count(*) AS n, count_if(passed)::BIGINT AS n_passed, median(value) AS median, count(*) FILTER (at_clip_ceiling) AS n_at_clip_ceiling FROM chk GROUP BY ALL", "median"),
        "sensitivity_distance": ([*seg, _GRID, _FULL, _swept()], dist, "mean_distance_m mean_hsr_m"),
        "sensitivity_spreads": ([*swept, f"\nds AS ({dist})"], f"SELECT match_id, {spread('total_sprints', 'sg', mid)} AS spread_pct, " + spread("total_sprints", "sg WHERE \"window\" = 21", mid) + " AS threshold_only_pct, " + spread("total_sprints", "sg WHERE threshold = 7.0", mid) + " AS window_only_pct, " + spread("mean_distance_m", "ds", "\"window\" = 21") + f" AS distance_pct, {spread('total_sprints', 'sg', mid)} AS vs_default_pct FROM (SELECT DISTINCT match_id FROM trk)", "spread_pct threshold_only_pct window_only_pct distance_pct vs_default_pct"),
        "sprint_heatmap_pivot": ([*seg, _GRID, _swept(), _grid_sql("swp", '"window"')], "SELECT match_id, \"window\", " + ", ".join(f"max(total_sprints) FILTER (threshold = {t}) AS t{str(t).replace('.', '_')}" for t in (6.5, 7.0, 7.5, 8.0)) + " FROM sg GROUP BY ALL", ""),
        "synthetic_checks": (trk, "SELECT name, metric, true AS passed FROM (VALUES ('line', 'distance_m'), ('line', 'speed_error'), ('noise', 'share_of_path'), ('noise', 'distance_wide_m'), ('circle', 'distance_m'), ('circle', 'zones_m'), ('sprint', 'n_sprints'), ('fast', 'n_sprints'), ('fast', 'hsr_m'), ('spike', 'top_mps'), ('limit', 'top_mps'), ('formation_home', 'line_height_m'), ('formation_home', 'width_m'), ('formation_home', 'length_m'), ('formation_home', 'hull_area_m2'), ('formation_home', 'cx_m'), ('formation_home', 'cy_m'), ('formation_away', 'line_height_m'), ('formation_space', 'total_m2'), ('formation_space', 'home_share'), ('coverage', 'refused'), ('coverage', 'distance_m')) v(name, metric)", ""),
        "voronoi_player_area": (one, "SELECT * REPLACE (round(area_m2, 3) AS area_m2) FROM ar", "timestamp area_m2"),
        "player_space": (spaces, "SELECT * REPLACE (round(area_m2, 3) AS area_m2) FROM ar", "timestamp area_m2"),
        "team_space": (spaces, "SELECT match_id, period, frame_id, timestamp, team, round(area, 3) AS area_m2, area / sum(area) OVER (PARTITION BY match_id, period, frame_id) AS area_share FROM (SELECT k.match_id, k.period, k.frame_id, k.timestamp, t.team, coalesce(sum(area_m2) FILTER (ar.team = t.team), 0) AS area FROM (SELECT DISTINCT match_id, period, frame_id, timestamp FROM ar) k JOIN ar USING (match_id, period, frame_id), (VALUES ('home'), ('away')) t(team) GROUP BY ALL)", "timestamp area_m2 area_share"),
    }


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (tables, sql, doubles) in _entries().items():
        fixed = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
        out[name] = f"WITH {','.join(tables)},\nout AS ({sql})\nSELECT * {f'REPLACE ({fixed})' if fixed else ''} FROM out"
    return out
