"""The queries as DuckDB SQL: one chain of common table expressions, written
apart from the DataFrame code, of which each query selects what it needs."""

from __future__ import annotations

import re

from modetrace.config import ALIASES, CANONICAL, DEFAULTS as S, EARTH_M, MODE_MAP
from modetrace.operators.model import REST, RULES, UNKNOWN
from modetrace.sources.fixture import duckdb_ctes

W = "PARTITION BY user_id ORDER BY t, event_id"
WT = "PARTITION BY user_id, trip_id ORDER BY t, event_id"
WS = "PARTITION BY user_id, trip_id ORDER BY t_start, seg_id"


def _distance(a: str, b: str) -> str:
    """Metres between (a_lat, a_lon) and (b_lat, b_lon)."""
    return f"""CASE WHEN {a}lat IS NOT NULL AND {b}lat IS NOT NULL THEN round(2 * {EARTH_M} * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2)
        + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))), 3) END"""


def _steps(source: str, window: str) -> str:
    return f"""SELECT *, CASE WHEN dt_us > 0 THEN dist_m / (CAST(dt_us AS DOUBLE) / 1e6) END AS v FROM (
      SELECT *, {_distance("p", "")} AS dist_m, t - pt AS dt_us FROM (
        SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(t) OVER w AS pt FROM {source} WINDOW w AS ({window})))"""


def _motion(source: str, window: str) -> str:
    return f"""SELECT *, CASE WHEN dt_us > 0 THEN (v - v0) / (CAST(dt_us AS DOUBLE) / 1e6) END AS a,
        round(least(turn, 360 - turn), 3) AS dh, CASE WHEN v0 > 0 THEN abs(v - v0) / v0 END AS vrate FROM (
      SELECT *, lag(v) OVER w AS v0, abs(heading - lag(heading) OVER w) AS turn FROM (
        SELECT *, round(degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)),
          cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))), 3) + 0.0 AS heading
        FROM ({_steps(source, window)}))
      WINDOW w AS ({window}))"""


def _features(source: str) -> str:
    def times(condition: str) -> str:
        return f"CAST(count(*) FILTER ({condition}) AS DOUBLE)"

    def share(kmh: float) -> str:
        return f"CAST(coalesce(sum(dt_us) FILTER (v * 3.6 > {kmh}), 0) AS DOUBLE) / CAST(sum(dt_us) FILTER (v IS NOT NULL) AS DOUBLE)"

    return f"""SELECT user_id, trip_id, seg_id, kind, length_m, v_max, v_median, v_p99, a_max, share_fast, share_very_fast, duration_us, t_start, t_end, n_points,
        CASE WHEN length_m > 0 THEN turns / length_m END AS hcr, CASE WHEN length_m > 0 THEN stops / length_m END AS sr, CASE WHEN length_m > 0 THEN changes / length_m END AS vcr, lat, lon
      FROM (SELECT user_id, trip_id, seg_id, kind, coalesce(CAST(sum(CAST(round(dist_m * 1000) AS BIGINT)) AS DOUBLE) / 1000.0, 0.0) AS length_m,
        {times(f"dh > {S.heading_deg}")} AS turns, {times(f"v < {S.stop_mps}")} AS stops, {times(f"vrate > {S.change_rate}")} AS changes,
        max(v) AS v_max, quantile_disc(v, 0.5) AS v_median, quantile_disc(v, 0.99) AS v_p99, max(a) AS a_max,
        {share(S.fast_kmh)} AS share_fast, {share(S.very_fast_kmh)} AS share_very_fast,
        max(t) - min(t) AS duration_us, min(t) AS t_start, max(t) AS t_end, count(*) AS n_points,
        min({{'t': t, 'e': event_id, 'lat': lat, 'lon': lon}}).lat AS lat, min({{'t': t, 'e': event_id, 'lat': lat, 'lon': lon}}).lon AS lon
      FROM {source} GROUP BY user_id, trip_id, seg_id, kind)"""


def _canonical(x: str) -> str:
    return f"CASE upper({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**MODE_MAP, **ALIASES}.items()) + " END"


def _starts(source: str, window: str, condition: str, name: str) -> str:
    return f"SELECT *, CAST(sum(st_) OVER ({window}) AS BIGINT) AS {name} FROM (SELECT *, CASE WHEN {condition} THEN 1 ELSE 0 END AS st_ FROM {source} WINDOW w AS ({window}))"


def _rule(what: int) -> str:
    value = (lambda x: f"'{x}'") if what == 0 else str
    first = f"CASE WHEN v_max IS NULL THEN {value(UNKNOWN[what])} "
    return first + " ".join(f"WHEN v_max <= {r[0]} THEN {value(r[1 + what])}" for r in RULES) + f" ELSE {value(REST[what])} END"


P = {m: f"p_{m.lower()}" for m in CANONICAL}
RESULT = ", ".join(["user_id", "trip_id", "kind", "seg_id", "mode", "confidence", *P.values(), "lat", "lon", "t_start", "t_end"])


def _with_mode(source: str, mode: str, rest: str = "") -> str:
    return f"SELECT user_id, trip_id, kind, seg_id, {mode} AS mode, confidence, {', '.join(P.values())}, lat, lon, t_start, t_end FROM {source}{rest}"


def _voted(source: str) -> str:
    half = S.vote // 2
    best = f"SELECT user_id, trip_id, seg_id, vote FROM (SELECT a.user_id, a.trip_id, a.seg_id, b.mode AS vote, row_number() OVER (PARTITION BY a.user_id, a.trip_id, a.seg_id ORDER BY count(*) DESC, b.mode) AS k FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND a.trip_id = b.trip_id AND b.r BETWEEN a.r - {half} AND a.r + {half} GROUP BY a.user_id, a.trip_id, a.seg_id, b.mode) WHERE k = 1"
    return f"WITH ranked AS (SELECT *, row_number() OVER ({WS}) AS r FROM {source}), best AS ({best}) " + _with_mode(f"{source} JOIN best USING (user_id, trip_id, seg_id)", "vote")


def _fused(source: str) -> str:
    return _with_mode(f"(SELECT *, lag(mode) OVER w AS a_, lead(mode) OVER w AS b_ FROM {source} WINDOW w AS ({WS}))", "CASE WHEN a_ = b_ AND a_ <> mode THEN a_ ELSE mode END")


def _named(source: str) -> str:
    return _with_mode(source, f"coalesce({_canonical('mode')}, upper(mode))")


def _corrected(source: str) -> str:
    long = " UNION ALL ".join(f"SELECT user_id, trip_id, seg_id, prev_, '{m}' AS m, {p} AS p_ FROM b_ WHERE confidence < {S.tau} AND prev_ IS NOT NULL" for m, p in P.items())
    return f"""WITH b_ AS (SELECT *, lag(mode) OVER ({WS}) AS prev_ FROM {source}), l_ AS ({long}),
      s_ AS (SELECT user_id, trip_id, seg_id, m, l_.p_ * coalesce(x.p, 0.0) AS score FROM l_ LEFT JOIN matrix x ON x.prev = l_.prev_ AND x.next = l_.m),
      best AS (SELECT user_id, trip_id, seg_id, m AS better FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trip_id, seg_id ORDER BY score DESC, m DESC) AS k FROM s_) WHERE k = 1 AND score > 0)
      """ + _with_mode(f"{source} LEFT JOIN best USING (user_id, trip_id, seg_id)", "coalesce(better, mode)")


def _micro(p: str) -> str:
    return f"CAST(round(ln(greatest(coalesce({p}, 0.0), {S.unseen})) * 1000000) AS BIGINT)"


def _time(source: str) -> str:
    return f"SELECT user_id, mode, us, CASE WHEN sum(us) OVER (PARTITION BY user_id) > 0 THEN 100.0 * CAST(us AS DOUBLE) / CAST(sum(us) OVER (PARTITION BY user_id) AS DOUBLE) END AS pct FROM (SELECT user_id, mode, CAST(sum(t_end - t_start) AS BIGINT) AS us FROM {source} GROUP BY user_id, mode)"


def _trips(kind: str) -> str:
    return f"""SELECT user_id, trip_id, kind, strftime(make_timestamp(min(t_start)), '%Y-%m-%d') AS date, CAST(hour(make_timestamp(min(t_start))) AS INTEGER) AS hour, min(t_start) AS t_start, max(t_end) AS t_end,
      array_to_string(list_sort(list_distinct(list(mode))), '|') AS predicted FROM post WHERE kind = '{kind}' GROUP BY user_id, trip_id, kind"""


def _split_by(group: str) -> str:
    return f"""SELECT "group", mode, us, CASE WHEN sum(us) OVER (PARTITION BY "group") > 0 THEN 100.0 * CAST(us AS DOUBLE) / CAST(sum(us) OVER (PARTITION BY "group") AS DOUBLE) END AS pct
      FROM (SELECT {group} AS "group", mode, CAST(sum(us) AS BIGINT) AS us FROM time_post LEFT JOIN individuals USING (user_id) GROUP BY 1, 2)"""


def _pyramid(kind: str) -> str:
    """Cells of every level, from the places themselves."""
    side = 1 << S.tile_bits
    y, x = (f"greatest(0, least({side - 1}, CAST(floor(({c} - {b[0]}) / ({b[1]} - {b[0]}) * {side}) AS BIGINT)))" for c, b in (("lat", S.lat), ("lon", S.lon)))
    code = " + ".join(f"(((({v} >> ({S.tile_bits} - level)) >> {i}) & 1) << {2 * i + k})" for i in range(S.tile_bits) for v, k in (("x_", 0), ("y_", 1)))
    group = ", kind" if kind else ""
    return f"SELECT CAST(level AS INTEGER) AS level, CAST({code} AS BIGINT) AS code{group}, count(*) AS n FROM (SELECT {y} AS y_, {x} AS x_, concat(prev, '→', mode) AS kind FROM changes) CROSS JOIN (SELECT unnest(range(0, {S.tile_bits + 1})) AS level) GROUP BY 1, 2{group and ', 3'}"


_AGES = "CASE WHEN age IS NULL THEN 'unknown' " + " ".join(f"WHEN age < {b} THEN '{a}-{b - 1}'" for a, b in zip((0, *S.ages), S.ages, strict=False)) + f" ELSE '{S.ages[-1]}+' END"
_TRIP_COLUMNS = "user_id, trip_id, kind, date, hour, t_start, t_end, predicted"



def _cell(x: str, per_degree: int) -> str:
    return f"CAST(floor({x} * {per_degree}) AS BIGINT)"


def _stays(source: str, prefix: str) -> dict[str, str]:
    """From each point the first one outside its radius, then the anchors that the scan reaches."""
    return {
        "stay_rows": f"SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY user_id) AS size_ FROM {source}",
        "stay_outside": f"SELECT a.user_id, a.rn, min(b.rn) AS j FROM {prefix}stay_rows a JOIN {prefix}stay_rows b ON a.user_id = b.user_id AND b.rn > a.rn AND {_distance('a.', 'b.')} > {S.stay_m} GROUP BY a.user_id, a.rn",
        "stay_jumps": f"SELECT a.user_id, a.rn, a.size_, b.rn + 1 AS j, b.t - a.t >= {S.stay_s * 1_000_000} AS stays FROM {prefix}stay_rows a LEFT JOIN {prefix}stay_outside o ON a.user_id = o.user_id AND a.rn = o.rn JOIN {prefix}stay_rows b ON a.user_id = b.user_id AND b.rn = coalesce(o.j, a.size_ + 1) - 1",
        "stay_anchors": f"SELECT user_id, rn, j, stays, size_ FROM {prefix}stay_jumps WHERE rn = 1 UNION ALL SELECT n.user_id, n.rn, n.j, n.stays, n.size_ FROM {prefix}stay_anchors p JOIN {prefix}stay_jumps n ON n.user_id = p.user_id AND n.rn = CASE WHEN p.stays THEN p.j ELSE p.rn + 1 END",
        "stay_flags": f"SELECT r.user_id, r.event_id, count(a.rn) > 0 AS stay FROM {prefix}stay_rows r LEFT JOIN {prefix}stay_anchors a ON a.user_id = r.user_id AND a.stays AND r.rn >= a.rn AND r.rn < a.j GROUP BY r.user_id, r.event_id",
    }


def _optics(radii: tuple[float, ...]) -> dict[str, str]:
    """Clusters at several radii, each from pairs of places within it."""
    out = {"reach_pairs": f"SELECT a.y, a.x, b.y AS y2, b.x AS x2, b.n AS n2, {_distance('a.', 'b.')} AS metres FROM fine a JOIN fine b ON abs(a.lat - b.lat) <= 0.02 AND {_distance('a.', 'b.')} <= {max(radii)}"}
    for i, r in enumerate(radii):
        out |= {
            f"o{i}_pairs": f"SELECT * FROM reach_pairs WHERE metres <= {r}",
            f"o{i}_cores": f"SELECT y, x, y * 4294967296 + x AS node FROM o{i}_pairs GROUP BY y, x HAVING sum(n2) >= {S.dense}",
            f"o{i}_links": f"SELECT DISTINCT a.node AS u, b.node AS v FROM o{i}_pairs p JOIN o{i}_cores a ON a.y = p.y AND a.x = p.x JOIN o{i}_cores b ON b.y = p.y2 AND b.x = p.x2",
            f"o{i}_reach": f"SELECT node AS u, node AS v FROM o{i}_cores UNION SELECT r.u, k.v FROM o{i}_reach r JOIN o{i}_links k ON k.u = r.v",
            f"o{i}_names": f"SELECT u AS node, min(v) AS cluster FROM o{i}_reach GROUP BY u",
            f"o{i}_nearest": f"SELECT p.y, p.x, min({{'m': p.metres, 'c': k.cluster}}).c AS cluster FROM o{i}_pairs p JOIN o{i}_cores c ON c.y = p.y2 AND c.x = p.x2 JOIN o{i}_names k ON k.node = c.node GROUP BY p.y, p.x",
        }
    return out | {"optics": " UNION ALL ".join(f"SELECT CAST({r} AS DOUBLE) AS radius, f.y AS lat_cell, f.x AS lon_cell, coalesce(k.cluster, -1) AS cluster FROM fine f LEFT JOIN o{i}_nearest k ON k.y = f.y AND k.x = f.x" for i, r in enumerate(radii))}


def _places(name: str, per_degree: int) -> dict[str, str]:
    """Places with change points, and their pairs within the radius."""
    near = f"abs(a.lat - b.lat) <= 0.01 AND {_distance('a.', 'b.')} <= {S.radius_m}"
    return {
        name: f"SELECT *, (y + 0.5) / {per_degree} AS lat, (x + 0.5) / {per_degree} AS lon FROM (SELECT {_cell('lat', per_degree)} AS y, {_cell('lon', per_degree)} AS x, count(*) AS n FROM changes GROUP BY 1, 2)",
        f"{name}_pairs": f"SELECT a.y, a.x, b.y AS y2, b.x AS x2, b.n AS n2, {_distance('a.', 'b.')} AS metres FROM {name} a JOIN {name} b ON {near}",
    }


CTES: dict[str, str] = {
    **duckdb_ctes(),
    "c1": "SELECT * FROM points WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)",
    "c2": "SELECT * FROM c1 WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180",
    "c3": f"SELECT * FROM c2 WHERE lat BETWEEN {S.lat[0]} AND {S.lat[1]} AND lon BETWEEN {S.lon[0]} AND {S.lon[1]}",
    "c4": f"SELECT user_id, event_id, t, lat, lon FROM (SELECT *, lead(v) OVER ({W}) AS out_ FROM ({_steps('c3', W)})) WHERE NOT coalesce(v > {S.spike_mps} AND out_ > {S.spike_mps}, false)",
    "c5": f"SELECT user_id, event_id, t, lat, lon FROM ({_steps('c4', W)}) WHERE NOT coalesce(dist_m < {S.merge_m} AND dt_us < {S.merge_s * 1_000_000}, false)",
    "c5_alone": f"SELECT user_id, event_id, t, lat, lon FROM ({_steps('c3', W)}) WHERE NOT coalesce(dist_m < {S.merge_m} AND dt_us < {S.merge_s * 1_000_000}, false)",
    # near repeats from the last point that stays: row by row
    **{f"{name}_rows": f"SELECT *, row_number() OVER ({W}) AS rn FROM {source}" for name, source in (("kept3", "c3"), ("kept4", "c4"))},
    **{name: f"SELECT user_id, event_id, t, lat, lon, rn, true AS stays, t AS kt, lat AS klat, lon AS klon FROM {name}_rows WHERE rn = 1 UNION ALL SELECT r.user_id, r.event_id, r.t, r.lat, r.lon, r.rn, NOT r.near, CASE WHEN r.near THEN r.kt ELSE r.t END, CASE WHEN r.near THEN r.klat ELSE r.lat END, CASE WHEN r.near THEN r.klon ELSE r.lon END FROM (SELECT n.*, k.kt, k.klat, k.klon, {_distance('k.k', 'n.')} < {S.merge_m} AND n.t - k.kt < {S.merge_s * 1_000_000} AS near FROM {name} k JOIN {name}_rows n ON n.user_id = k.user_id AND n.rn = k.rn + 1) r" for name in ("kept3", "kept4")},
    "motion": _motion("c5", W),
    "declared": "SELECT user_id, event_id, t, lat, lon, blk FROM (SELECT p.*, d.blk, row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY d.t_start, d.blk) AS k FROM c5 p JOIN displacements d ON p.user_id = d.user_id AND p.t BETWEEN d.t_start AND d.t_end) WHERE k = 1",
    "extra": "SELECT * FROM c5 p WHERE NOT EXISTS (SELECT 1 FROM displacements d WHERE p.user_id = d.user_id AND p.t BETWEEN d.t_start AND d.t_end)",
    "gaps": _starts("extra", W, f"t - lag(t) OVER w > {S.gap_s * 1_000_000}", "n"),
    "trips": "SELECT user_id, event_id, t, lat, lon, 'declared' AS kind, concat('D-', user_id, '-', blk) AS trip_id FROM declared UNION ALL SELECT user_id, event_id, t, lat, lon, 'extra', concat('E-', user_id, '-', n) FROM gaps",
    "trip_motion": _motion("trips", WT),
    "labelled": f"SELECT *, coalesce(known, lead(known) OVER ({WT}), 'walk') AS label FROM (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN v <= {S.walk_mps} AND coalesce(abs(a) <= {S.walk_mps2}, true) THEN 'walk' ELSE 'other' END END AS known FROM trip_motion)",
    "runs": _starts("labelled", WT, "label <> lag(label) OVER w", "run"),
    "subs": f"SELECT *, (t - min(t) OVER (PARTITION BY user_id, trip_id, run)) // {S.max_segment_s * 1_000_000} AS sub FROM (SELECT * EXCLUDE (st_) FROM runs)",
    "seg_v1": _starts("subs", WT, "run <> lag(run) OVER w OR sub <> lag(sub) OVER w", "seg_id"),
    "merged_label": f"SELECT * EXCLUDE (label, run), coalesce(last_value(CASE WHEN size_ >= {S.short_points} OR run = 0 THEN label END IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), label) AS label FROM (SELECT * EXCLUDE (st_), count(*) OVER (PARTITION BY user_id, trip_id, run) AS size_ FROM runs)",
    "merged": _starts("merged_label", WT, "label <> lag(label) OVER w", "run"),
    "smooth": f"SELECT *, CAST(sum(mm_) OVER w3 AS DOUBLE) / nullif(count(mm_) OVER w3, 0) AS smooth_ FROM (SELECT *, CAST(round(v * 1000) AS BIGINT) AS mm_ FROM trip_motion) WINDOW w3 AS ({WT} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "breaks": _starts("smooth", WT, f"lag(smooth_) OVER w > 0 AND abs(smooth_ - lag(smooth_) OVER w) / lag(smooth_) OVER w >= {S.break_rate}", "seg_id"),
    # the best cut of a trip: forward over its points with lists of what is best so far, then back
    "speeds": f"SELECT user_id, trip_id, event_id, row_number() OVER ({WT}) AS r, CAST(round(v * 1000) AS BIGINT) AS x FROM trip_motion",
    "profiles": "SELECT user_id, trip_id, count(*) AS size_, list_prepend(CAST(0 AS HUGEINT), list(c ORDER BY r)) AS c, list_prepend(CAST(0 AS HUGEINT), list(s ORDER BY r)) AS s, list_prepend(CAST(0 AS HUGEINT), list(q ORDER BY r)) AS q FROM (SELECT user_id, trip_id, r, CAST(sum(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER w AS HUGEINT) AS c, CAST(sum(coalesce(x, 0)) OVER w AS HUGEINT) AS s, CAST(sum(coalesce(x * x, 0)) OVER w AS HUGEINT) AS q FROM speeds WINDOW w AS (PARTITION BY user_id, trip_id ORDER BY r)) GROUP BY user_id, trip_id",
    "cutting": f"SELECT user_id, trip_id, CAST(0 AS BIGINT) AS j, [CAST(0 AS DOUBLE)] AS best, [CAST(0 AS BIGINT)] AS back FROM profiles UNION ALL SELECT user_id, trip_id, j + 1, list_append(best, w.v + {S.break_penalty}), list_append(back, w.i) FROM (SELECT k.user_id, k.trip_id, k.j, k.best, k.back, list_min(list_transform(range(0, k.j + 1), lambda i: {{'v': k.best[i + 1] + CASE WHEN p.c[k.j + 2] > p.c[i + 1] THEN round_even(CAST(p.q[k.j + 2] - p.q[i + 1] AS DOUBLE) - CAST((p.s[k.j + 2] - p.s[i + 1]) AS DOUBLE) * CAST((p.s[k.j + 2] - p.s[i + 1]) AS DOUBLE) / CAST(p.c[k.j + 2] - p.c[i + 1] AS DOUBLE), 0) ELSE 0 END, 'i': i}})) AS w FROM cutting k JOIN profiles p ON p.user_id = k.user_id AND p.trip_id = k.trip_id WHERE k.j < p.size_)",
    "cut_places": "SELECT k.user_id, k.trip_id, k.j AS place, k.back FROM cutting k JOIN profiles p ON p.user_id = k.user_id AND p.trip_id = k.trip_id AND p.size_ = k.j UNION ALL SELECT user_id, trip_id, back[place + 1], back FROM cut_places WHERE place > 0",
    "cut_numbers": "SELECT user_id, trip_id, event_id, CAST((SELECT count(*) FROM cut_places c WHERE c.user_id = m.user_id AND c.trip_id = m.trip_id AND c.place > 0 AND c.place < m.r) AS BIGINT) AS seg_id FROM speeds m",
    "seg_optimal": "SELECT m.*, n.seg_id FROM trip_motion m JOIN cut_numbers n USING (user_id, trip_id, event_id)",
    "features_optimal": _features("seg_optimal"),
    "features_v1": _features("seg_v1"),
    "features_v2": _features("breaks"),
    "users": "SELECT DISTINCT user_id FROM points",
    "split": f"SELECT user_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) <= (count(*) OVER () * {S.train_tenths}) // 10 THEN 'train' ELSE 'test' END AS split FROM users",
    "declared_modes": "SELECT user_id, concat('D-', user_id, '-', blk) AS trip_id, mode_1 FROM displacements",
    "rule": f"SELECT {RESULT} FROM (SELECT *, " + ", ".join(f"CASE WHEN mode = '{m}' THEN confidence ELSE (1 - confidence) / 6 END AS {p}" for m, p in P.items()) + f" FROM (SELECT *, {_rule(0)} AS mode, CAST({_rule(1)} AS DOUBLE) AS confidence FROM features_v1))",
    "rule_train": "SELECT * FROM rule WHERE user_id IN (SELECT user_id FROM split WHERE split = 'train')",
    "rule_test": "SELECT * FROM rule WHERE user_id IN (SELECT user_id FROM split WHERE split = 'test')",
    "matrix": f"SELECT prev, next, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY prev) AS DOUBLE) AS p FROM (SELECT prev, next, count(*) AS n FROM (SELECT lag(mode) OVER ({WS}) AS prev, mode AS next FROM rule_train) WHERE prev IS NOT NULL GROUP BY prev, next)",
    "corrected": _corrected("rule_test"),
    # the best sequence of a trip: forward over its segments, then back from the last one
    "step_rows": f"SELECT *, row_number() OVER ({WS}) AS r, count(*) OVER (PARTITION BY user_id, trip_id) AS size_ FROM rule_test",
    "step_logs": " UNION ALL ".join(f"SELECT user_id, trip_id, r, size_, '{m}' AS m, {_micro(p)} AS w FROM step_rows WHERE confidence < {S.tau} OR mode = '{m}'" for m, p in P.items()),
    "move_logs": f"SELECT a.m AS prev, b.m AS next, {_micro('x.p')} AS w FROM (SELECT unnest({list(CANONICAL)}) AS m) a CROSS JOIN (SELECT unnest({list(CANONICAL)}) AS m) b LEFT JOIN matrix x ON x.prev = a.m AND x.next = b.m",
    "forward": "SELECT user_id, trip_id, r, size_, m, w AS score, '' AS back FROM step_logs WHERE r = 1 UNION ALL SELECT n.user_id, n.trip_id, n.r, n.size_, n.m, max({'s': f.score + v.w, 'k': f.m}).s + any_value(n.w), max({'s': f.score + v.w, 'k': f.m}).k FROM forward f JOIN step_logs n ON n.user_id = f.user_id AND n.trip_id = f.trip_id AND n.r = f.r + 1 JOIN move_logs v ON v.prev = f.m AND v.next = n.m GROUP BY n.user_id, n.trip_id, n.r, n.size_, n.m",
    "backward": "SELECT user_id, trip_id, r, max({'s': score, 'k': m}).k AS m FROM forward WHERE r = size_ GROUP BY user_id, trip_id, r UNION ALL SELECT f.user_id, f.trip_id, b.r - 1, f.back FROM backward b JOIN forward f ON f.user_id = b.user_id AND f.trip_id = b.trip_id AND f.r = b.r AND f.m = b.m WHERE b.r > 1",
    "sequenced": _with_mode("step_rows JOIN (SELECT user_id, trip_id, r, m FROM backward) USING (user_id, trip_id, r)", "CASE WHEN confidence < " + str(S.tau) + " THEN m ELSE mode END"),
    "voted": _voted("corrected"),
    "fused": _fused("voted"),
    "post": _named("fused"),
    "time_post": _time("post"),
    "sets": f"SELECT user_id, trip_id, list_distinct(list(mode)) AS m, any_value({_canonical('mode_1')}) AS d FROM post JOIN declared_modes USING (user_id, trip_id) GROUP BY user_id, trip_id",
    "metrics": "SELECT user_id, trip_id, CAST(hit AS DOUBLE) / size AS precision, CAST(hit AS DOUBLE) AS recall, CASE WHEN hit > 0 THEN 2 * (CAST(hit AS DOUBLE) / size) * CAST(hit AS DOUBLE) / (CAST(hit AS DOUBLE) / size + hit) ELSE 0.0 END AS f1 FROM (SELECT user_id, trip_id, len(m) AS size, CAST(list_contains(m, d) AS INTEGER) AS hit FROM sets WHERE d IS NOT NULL)",
    "plain_windows": "SELECT * FROM (SELECT user_id, blk, mode_1, greatest(t_start, coalesce(max(t_end) OVER (PARTITION BY user_id ORDER BY t_start, blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, t_start)) AS t_start, t_end FROM displacements) WHERE t_start < t_end",
    "overlapping": f"SELECT d.user_id, concat('D-', d.user_id, '-', d.blk) AS trip_id, p.mode AS predicted, {_canonical('d.mode_1')} AS declared, CAST(sum(least(p.t_end, d.t_end) - greatest(p.t_start, d.t_start)) AS BIGINT) AS us FROM plain_windows d JOIN post p ON p.user_id = d.user_id AND p.t_start < d.t_end AND d.t_start < p.t_end AND p.t_start < p.t_end GROUP BY 1, 2, 3, 4",
    "uncovered": f"SELECT user_id, trip_id, NULL AS predicted, declared, CAST(t_end - t_start - coalesce(us, 0) AS BIGINT) AS us FROM (SELECT user_id, concat('D-', user_id, '-', blk) AS trip_id, {_canonical('mode_1')} AS declared, t_start, t_end FROM plain_windows) LEFT JOIN (SELECT user_id, trip_id, sum(us) AS us FROM overlapping GROUP BY user_id, trip_id) USING (user_id, trip_id) WHERE user_id IN (SELECT user_id FROM users)",
    "pair_times": "SELECT * FROM overlapping UNION ALL SELECT * FROM uncovered WHERE us > 0",
    "time_sums": "SELECT user_id, trip_id, CAST(sum(us) AS BIGINT) AS declared_us, CAST(coalesce(sum(us) FILTER (predicted IS NOT NULL), 0) AS BIGINT) AS predicted_us, CAST(coalesce(sum(us) FILTER (predicted = declared), 0) AS BIGINT) AS hit_us FROM pair_times WHERE declared IS NOT NULL GROUP BY user_id, trip_id",
    "changes": f"SELECT user_id, trip_id, seg_id, t_start AS t, lat, lon, prev, mode FROM (SELECT *, lag(mode) OVER ({WS}) AS prev FROM post) WHERE prev <> mode",
    "declared_trips": f"SELECT {_TRIP_COLUMNS}, {_canonical('mode_1')} AS declared, precision, recall, f1 FROM ({_trips('declared')}) LEFT JOIN declared_modes USING (user_id, trip_id) LEFT JOIN metrics USING (user_id, trip_id)",
    "extra_trips": _trips("extra"),
    **_stays("c5", ""),
    # the same over extra points only
    **{f"extra_{k}": v for k, v in _stays("extra", "extra_").items()},
    "stays": "SELECT user_id, event_id, stay FROM stay_flags",
    "extra_stays": "SELECT e.*, s.stay FROM extra e JOIN extra_stay_flags s USING (user_id, event_id)",
    "stay_gaps": _starts("extra_stays", W, f"t - lag(t) OVER w > {S.gap_s * 1_000_000} OR (lag(stay) OVER w AND NOT stay)", "n"),
    **_places("place", S.places_per_degree),
    **_places("fine", S.cluster_cells),
    **_optics((60.0, 200.0, 450.0)),
    "cores": f"SELECT y, x, y * 4294967296 + x AS node FROM fine_pairs GROUP BY y, x HAVING sum(n2) >= {S.dense}",
    "core_links": "SELECT DISTINCT a.node AS u, b.node AS v FROM fine_pairs p JOIN cores a ON a.y = p.y AND a.x = p.x JOIN cores b ON b.y = p.y2 AND b.x = p.x2",
    "core_reach": "SELECT node AS u, node AS v FROM cores UNION SELECT r.u, k.v FROM core_reach r JOIN core_links k ON k.u = r.v",
    "core_names": "SELECT u AS node, min(v) AS cluster FROM core_reach GROUP BY u",
    "nearest_core": "SELECT p.y, p.x, min({'m': p.metres, 'c': k.cluster}).c AS cluster FROM fine_pairs p JOIN cores c ON c.y = p.y2 AND c.x = p.x2 JOIN core_names k ON k.node = c.node GROUP BY p.y, p.x",
    "found_clusters": "SELECT f.y AS lat_cell, f.x AS lon_cell, coalesce(k.cluster, -1) AS cluster FROM fine f LEFT JOIN nearest_core k ON k.y = f.y AND k.x = f.x",
    "shares": f"SELECT cluster, mode, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY cluster) AS share FROM found_clusters JOIN changes ON {_cell('lat', S.cluster_cells)} = lat_cell AND {_cell('lon', S.cluster_cells)} = lon_cell WHERE cluster >= 0 GROUP BY cluster, mode",
    "placed_rule": f"SELECT r.*, k.cluster FROM rule_test r LEFT JOIN (SELECT * FROM found_clusters WHERE cluster >= 0) k ON {_cell('r.lat', S.cluster_cells)} = k.lat_cell AND {_cell('r.lon', S.cluster_cells)} = k.lon_cell",
    "spatial_best": "SELECT user_id, trip_id, seg_id, m AS better FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trip_id, seg_id ORDER BY score DESC, m DESC) AS k FROM (SELECT user_id, trip_id, seg_id, l.m, l.p * coalesce(share, 0.0) AS score FROM ("
    + " UNION ALL ".join(f"SELECT user_id, trip_id, seg_id, cluster, '{m}' AS m, {p} AS p FROM placed_rule WHERE confidence < {S.tau} AND cluster IS NOT NULL" for m, p in P.items())
    + ") l LEFT JOIN shares s ON s.cluster = l.cluster AND s.mode = l.m)) WHERE k = 1 AND score > 0",
}
RECURSIVE = {"stay_anchors", "extra_stay_anchors", "core_reach", "forward", "backward", "kept3", "kept4", "cutting", "cut_places", "o0_reach", "o1_reach", "o2_reach"}

_POINT = "user_id, event_id, t, lat, lon"
_SEG = "user_id, event_id, trip_id"

#: What each query selects.
SELECTS: dict[str, str] = {
    "fx_points": f"SELECT {_POINT} FROM points",
    "fx_displacements": "SELECT user_id, blk, t_start, t_end, mode_1 FROM displacements",
    "fx_individuals": "SELECT user_id, sex, age, diploma FROM individuals",
    "c1_nan": f"SELECT {_POINT} FROM c1",
    "c2_range": f"SELECT {_POINT} FROM c2",
    "c3_region": f"SELECT {_POINT} FROM c3",
    "c4_spikes": f"SELECT {_POINT} FROM c4",
    "c5_fusion": f"SELECT {_POINT} FROM c5_alone",
    "c5_from_kept": f"SELECT {_POINT} FROM kept3 WHERE stays",
    "c6_from_kept": f"SELECT {_POINT} FROM kept4 WHERE stays",
    "c6_clean": f"SELECT {_POINT} FROM c5",
    **{k: f"SELECT user_id, event_id, {c} FROM motion" for k, c in (("k1_distance", "dist_m"), ("k2_delta", "dt_us"), ("k3_speed", "v"), ("k4_accel", "a"), ("k5_heading", "heading"), ("k6_turn", "dh"), ("k7_vrate", "vrate"))},
    "g1_declared": f"SELECT {_POINT}, blk FROM declared",
    "g2_extra": f"SELECT {_POINT} FROM extra",
    "g3_gap": f"SELECT {_POINT}, n FROM gaps",
    "g5_trip_id": f"SELECT {_POINT}, kind, trip_id FROM trips",
    "g6_walk": f"SELECT {_SEG}, label FROM labelled",
    "g7_runs": f"SELECT {_SEG}, run FROM runs",
    "g8_sub": f"SELECT {_SEG}, seg_id FROM seg_v1",
    "g9_short": f"SELECT {_SEG}, label, run FROM merged",
    "g10_breaks": f"SELECT {_SEG}, seg_id FROM breaks",
    "g10_optimal": f"SELECT {_SEG}, seg_id FROM seg_optimal",
    "g10_optimal_features": "SELECT user_id, trip_id, seg_id, hcr, sr, vcr, v_max, a_max FROM features_optimal",
    **{f"f{i}_{n}": f"SELECT user_id, trip_id, seg_id, {n} FROM features_v1" for i, n in enumerate(("hcr", "sr", "vcr", "v_max", "v_median", "v_p99", "a_max", "share_fast", "share_very_fast", "duration_us", "length_m"), 1)},
    **dict.fromkeys(("features_v1", "s5_stored_features"), "SELECT * FROM features_v1"),
    "features_v2": "SELECT user_id, trip_id, seg_id, hcr, sr, vcr, v_max, a_max FROM features_v2",
    "t0_split": "SELECT user_id, split FROM split",
    "t1_train": "SELECT user_id, trip_id, seg_id FROM features_v1 WHERE user_id IN (SELECT user_id FROM split WHERE split = 'train')",
    "t2_join": "SELECT user_id, trip_id, seg_id, mode_1 FROM features_v1 JOIN declared_modes USING (user_id, trip_id)",
    "t3_map": f"SELECT user_id, trip_id, mode_1, {_canonical('mode_1')} AS mode FROM declared_modes",
    "t4_other": f"SELECT user_id, trip_id, {_canonical('mode_1')} AS mode FROM declared_modes WHERE {_canonical('mode_1')} IS NOT NULL",
    **{
        f"t5_training_{m}": f"SELECT user_id, trip_id, seg_id, {c}, {_canonical('mode_1')} AS mode FROM features_{m} JOIN declared_modes USING (user_id, trip_id) WHERE user_id IN (SELECT user_id FROM split WHERE split = 'train') AND {_canonical('mode_1')} IS NOT NULL"
        for m, c in (("v1", "hcr, sr, vcr, v_max, a_max, v_median, v_p99, share_fast, share_very_fast, duration_us, length_m"), ("v2", "hcr, sr, vcr, v_max, a_max"))
    },
    "m7_rule": f"SELECT {RESULT} FROM rule",
    "p1_matrix": "SELECT prev, next, n, p FROM matrix",
    "p2_correct": f"SELECT {RESULT} FROM corrected",
    "p2_sequence": f"SELECT {RESULT} FROM sequenced",
    "p2_sequence_events": f"SELECT {RESULT} FROM sequenced",
    "p3_vote": f"SELECT {RESULT} FROM ({_voted('rule_test')})",
    "p4_fusion": f"SELECT {RESULT} FROM ({_fused('rule_test')})",
    "p5_names": f"SELECT {RESULT} FROM ({_named('rule_test')})",
    "p6_time": "SELECT user_id, mode, us, pct FROM time_post",
    "p7_metrics": "SELECT user_id, trip_id, precision, recall, f1 FROM metrics",
    "p7_pairs": "SELECT user_id, trip_id, predicted, declared, us FROM pair_times",
    **dict.fromkeys(("p7_time", "p7_time_events"), "SELECT user_id, trip_id, declared_us, predicted_us, hit_us, CAST(hit_us AS DOUBLE) / predicted_us AS precision, CAST(hit_us AS DOUBLE) / declared_us AS recall, CASE WHEN hit_us > 0 THEN 2 * (CAST(hit_us AS DOUBLE) / predicted_us) * (CAST(hit_us AS DOUBLE) / declared_us) / (CAST(hit_us AS DOUBLE) / predicted_us + CAST(hit_us AS DOUBLE) / declared_us) ELSE 0.0 END AS f1 FROM time_sums WHERE predicted_us > 0"),
    "p8_info": "SELECT user_id, sex, age, diploma FROM users LEFT JOIN individuals USING (user_id)",
    "p9_radius": f"SELECT a.user_id, a.trip_id, a.seg_id, count(*) - 1 AS n FROM changes a JOIN changes b ON abs(a.lat - b.lat) <= 0.01 AND {_distance('a.', 'b.')} <= {S.radius_m} GROUP BY a.user_id, a.trip_id, a.seg_id",
    "p9_clusters": "SELECT lat_cell, lon_cell, cluster FROM found_clusters",
    "p9_optics": "SELECT radius, lat_cell, lon_cell, cluster FROM optics",
    "p9_nearest": f"SELECT user_id, trip_id, seg_id, CAST(rank AS INTEGER) AS rank, near_user_id, near_trip_id, near_seg_id, metres FROM (SELECT a.user_id, a.trip_id, a.seg_id, b.user_id AS near_user_id, b.trip_id AS near_trip_id, b.seg_id AS near_seg_id, {_distance('a.', 'b.')} AS metres, row_number() OVER (PARTITION BY a.user_id, a.trip_id, a.seg_id ORDER BY {_distance('a.', 'b.')}, b.user_id, b.trip_id, b.seg_id) AS rank FROM changes a JOIN changes b ON (a.user_id, a.trip_id, a.seg_id) <> (b.user_id, b.trip_id, b.seg_id)) WHERE rank <= {S.nearest}",
    "p9_spatial": f"SELECT {RESULT} FROM ({_with_mode('rule_test LEFT JOIN spatial_best USING (user_id, trip_id, seg_id)', 'coalesce(better, mode)')})",
    "g4_stay_trips": f"SELECT {_POINT}, 'declared' AS kind, concat('D-', user_id, '-', blk) AS trip_id FROM declared UNION ALL SELECT {_POINT}, 'extra', concat('E-', user_id, '-', n) FROM stay_gaps",
    "g4_stay": "SELECT user_id, event_id, stay FROM stays",
    "p10_post": f"SELECT {RESULT} FROM post",
    "a1_test": f"SELECT {RESULT} FROM rule_test",
    "a3_changes": "SELECT user_id, trip_id, seg_id, t, lat, lon, prev, mode FROM changes",
    "a4_declared": "SELECT * FROM declared_trips",
    "a5_trips": f"SELECT {_TRIP_COLUMNS}, declared, precision, recall, f1 FROM declared_trips UNION ALL SELECT {_TRIP_COLUMNS}, NULL, NULL, NULL, NULL FROM extra_trips",
    "a6_histogram": "SELECT prev, mode, count(*) AS n FROM changes GROUP BY prev, mode",
    "a7_matrix": "SELECT prev, " + ", ".join(f"count(*) FILTER (mode = '{m}') AS to_{m.lower()}" for m in CANONICAL) + " FROM changes GROUP BY prev",
    "a8_density": f"SELECT CAST(floor(lat * {S.cells_per_degree}) AS BIGINT) AS lat_cell, CAST(floor(lon * {S.cells_per_degree}) AS BIGINT) AS lon_cell, count(*) AS n FROM changes GROUP BY 1, 2",
    "s9_pyramid": _pyramid("kind"),
    "s10_pyramid": _pyramid(""),
    "a9_labels": "SELECT user_id, trip_id, seg_id, t, concat(prev, '→', mode) AS kind FROM changes",
    "a10_sex": _split_by("coalesce(sex, 'unknown')"),
    "a11_age": _split_by(_AGES),
    "a12_diploma": _split_by("coalesce(diploma, 'unknown')"),
    "a10_a12_splits": " UNION ALL ".join(f"SELECT '{by}' AS \"by\", * FROM ({_split_by(group)})" for by, group in (("sex", "coalesce(sex, 'unknown')"), ("age", _AGES), ("diploma", "coalesce(diploma, 'unknown')"))),
}


#: Queries over the rides, and what they select.
RIDES: dict[str, str] = {
    **{k: SELECTS.pop(k) for k in ("s9_pyramid", "s10_pyramid", "a3_changes", "a6_histogram", "a7_matrix", "a8_density", "a9_labels", "p9_radius", "p9_clusters", "p9_spatial", "p2_sequence", "g10_optimal", "g10_optimal_features", "p9_optics", "p9_nearest", "p7_pairs", "p7_time")},
    "long_features_v1": SELECTS["features_v1"],
    "long_features_v2": SELECTS["features_v2"],
    "long_post": SELECTS["p10_post"],
    **{f"rides_{k}": SELECTS[v] for k, v in (("points", "fx_points"), ("displacements", "fx_displacements"), ("matrix", "p1_matrix"), ("post", "p10_post"), ("metrics", "p7_metrics"), ("trips", "a5_trips"))},
}


def _queries(ctes: dict[str, str], selects: dict[str, str]) -> dict[str, str]:
    cache: dict[str, set[str]] = {}
    for n in ctes:  # each refers to earlier ones only
        direct = {m for m in cache if re.search(rf"\b{m}\b", ctes[n])}
        cache[n] = direct.union(*(cache[m] for m in direct))
    out = {}
    for key, sql in selects.items():
        direct = {m for m in ctes if re.search(rf"\b{m}\b", sql)}
        used = direct.union(*(cache[m] for m in direct))
        start = "WITH RECURSIVE " if used & RECURSIVE else "WITH "
        out[key] = start + ",\n".join(f"{n} AS ({ctes[n]})" for n in ctes if n in used) + f"\n{sql}"
    return out


def oracle_sql() -> dict[str, str]:
    return _queries(CTES, SELECTS) | _queries(CTES | duckdb_ctes("rides"), RIDES)
