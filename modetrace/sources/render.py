"""Maps as self-contained HTML, and figures as PNG.

They draw aggregates. A map that would have more than ``LIMIT`` marks is drawn
with coarser places, so that every change is counted in one of them.
"""

from __future__ import annotations

import html
import json
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modetrace.config import CANONICAL, DEFAULTS, Settings
from modetrace.operators.analyse import tile_pyramid, transition_labels
from modetrace.sources.png import SILVER, Canvas

LIMIT = 5000
#: Pixels of the longest bar of a figure.
BAR = 320
PALETTE = {m: f"hsl({i * 360 // len(CANONICAL)},65%,45%)" for i, m in enumerate(CANONICAL)}
#: A colour for each type of transition: the hue tells the mode before, the lightness the mode after.
TYPES = {f"{a}→{b}": f"hsl({i * 360 // len(CANONICAL)},75%,{25 + 8 * j}%)" for i, a in enumerate(CANONICAL) for j, b in enumerate(CANONICAL) if a != b}
#: Places of a map, from fine to coarse: so many to a degree, and so many cells of ``change_density`` to a side.
PER_DEGREE, SIDES = (10_000, 2000, 500, 100, 20, 5, 1), (1, 2, 5, 10, 50, 200, 1000)
#: Wheel and drag change the part of a picture that shows.
_MOVE = """<script>
const s = document.querySelector("svg"), v = s.viewBox.baseVal;
s.addEventListener("wheel", e => {
  e.preventDefault();
  const k = e.deltaY > 0 ? 1.2 : 1 / 1.2, r = s.getBoundingClientRect();
  v.x += (e.clientX - r.left) / r.width * v.width * (1 - k);
  v.y += (e.clientY - r.top) / r.height * v.height * (1 - k);
  v.width *= k;
  v.height *= k;
}, { passive: false });
s.addEventListener("pointermove", e => {
  if (!e.buttons) return;
  const r = s.getBoundingClientRect();
  v.x -= e.movementX / r.width * v.width;
  v.y -= e.movementY / r.height * v.height;
});
</script>"""
_W, _H = 900, 700
#: Marks of a level of the pyramid that a page may carry; finer levels than that are left out.
EMBED = 20_000
#: After each move the page draws the finest level that has at most so many marks in view.
_LEVELS = """<script>
const marks = s.querySelector("#marks");
function drawn(level) {
  return level.filter(m => m[0] >= v.x && m[0] <= v.x + v.width && m[1] >= v.y && m[1] <= v.y + v.height);
}
function redraw() {
  for (const level of LEVELS) {  // from fine to coarse
    const shown = drawn(level);
    if (shown.length > LIMIT) continue;
    const size = v.width / 900;
    marks.innerHTML = shown.map(m => `<circle cx="${m[0]}" cy="${m[1]}" r="${(3 + m[2] ** 0.25) * size}" fill="${m[4]}" fill-opacity="0.6"><title>${m[3]}: ${m[2]}</title></circle>`).join("");
    return;
  }
}
s.addEventListener("wheel", redraw);
s.addEventListener("pointerup", redraw);
</script>"""


def _page(title: str, body: str, note: str = "") -> str:
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{html.escape(note)}</p>{body}'


def _svg(parts: list[str], width: int = _W, height: int = _H) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" font-family="sans-serif" font-size="12">{"".join(parts)}</svg>'


def _place(rows: list, lat: str, lon: str):
    """From coordinates to the picture."""
    lats, lons = [r[lat] for r in rows] or [0.0], [r[lon] for r in rows] or [0.0]
    low, west = min(lats), min(lons)
    tall, wide = max(max(lats) - low, 1e-9), max(max(lons) - west, 1e-9)
    return lambda r: (20 + (r[lon] - west) / wide * (_W - 40), _H - 20 - (r[lat] - low) / tall * (_H - 40))


def _coarse_enough(rows: DataFrame, places: list[list], *kinds: str) -> list:
    """The finest of the ``places``, lists of columns, that gives LIMIT marks at most."""
    numbers = rows.agg(*(F.approx_count_distinct(F.struct(*place, *kinds), 0.02).alias(f"n{i}") for i, place in enumerate(places))).first()
    return next((place for place, n in zip(places, numbers, strict=True) if n <= 0.9 * LIMIT), places[-1])


def cell_centre(code: int, level: int, s: Settings = DEFAULTS) -> tuple[float, float]:
    """Latitude and longitude of the middle of a cell of ``tile_pyramid``."""
    y = sum((code >> 2 * i + 1 & 1) << i for i in range(level))
    x = sum((code >> 2 * i & 1) << i for i in range(level))
    return tuple(low + (high - low) * (k + 0.5) / (1 << level) for k, (low, high) in ((y, s.lat), (x, s.lon)))


def _levels(pyramid: DataFrame, xy, color, s: Settings = DEFAULTS) -> str:
    """Data and script of the pyramid's levels: [x, y, n, title, colour] of each mark,
    levels from fine to coarse."""
    sizes = {r.level: r["count"] for r in pyramid.groupBy("level").count().collect()}  # a row a level
    kept = [level for level, n in sizes.items() if n <= EMBED]
    levels: dict[int, list] = {}
    for r in pyramid.where(F.col("level").isin(kept)).orderBy("level", "code").collect():
        lat, lon = cell_centre(r.code, r.level, s)
        x, y = xy({"lat": lat, "lon": lon})
        kind = r.kind if "kind" in pyramid.columns else "changes"
        levels.setdefault(r.level, []).append([round(x, 2), round(y, 2), r.n, kind, color(kind)])
    data = json.dumps([levels[k] for k in sorted(levels, reverse=True)], ensure_ascii=False).replace("<", "\\u003c")
    return f"<script>const LIMIT = {LIMIT}, LEVELS = {data};</script>{_LEVELS}"


def transition_map(changes: DataFrame, path: str) -> None:
    """Change points by place, coloured and titled by the type of transition."""
    labelled = transition_labels(changes)
    place = _coarse_enough(labelled, [[((F.floor(F.col(c) * n) + 0.5) / n).alias(c) for c in ("lat", "lon")] for n in PER_DEGREE], "kind")
    rows = labelled.groupBy(*place, "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lat", "lon", "kind").collect()
    xy, by_type = _place(rows, "lat", "lon"), Counter()
    dots = []
    for r in rows:
        x, y = xy(r)
        by_type[r.kind] += r.n
        dots.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{3 + r.n**0.25:.1f}" fill="{TYPES.get(r.kind, "gray")}" fill-opacity="0.6"><title>{html.escape(r.kind)}: {r.n}</title></circle>')
    legend = "".join(f'<li><span style="background:{TYPES.get(k, "gray")}">&emsp;</span> {html.escape(k)}: {n}</li>' for k, n in by_type.most_common())
    levels = _levels(tile_pyramid(labelled, "kind"), xy, lambda kind: TYPES.get(kind, "gray"))
    Path(path).write_text(_page("Mode changes", f"{_svg(['<g id=marks>', *dots, '</g>'])}<ul>{legend}</ul>{_MOVE}{levels}", f"{by_type.total()} changes at {len(rows)} places and types"), encoding="utf-8")


def density_map(density: DataFrame, path: str) -> None:
    """Cells of ``change_density``, darker the more changes they hold."""
    cell = _coarse_enough(density, [[F.floor(F.col(c) / n).alias(c) for c in ("lat_cell", "lon_cell")] for n in SIDES])
    rows = density.groupBy(*cell).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lat_cell", "lon_cell").collect()
    xy, most = _place(rows, "lat_cell", "lon_cell"), max((r.n for r in rows), default=1)
    cells = [f'<rect x="{xy(r)[0] - 4:.1f}" y="{xy(r)[1] - 4:.1f}" width="8" height="8" fill="crimson" fill-opacity="{0.15 + 0.85 * r.n / most:.2f}"><title>{r.n}</title></rect>' for r in rows]
    Path(path).write_text(_page("Density of mode changes", _svg(cells) + _MOVE, f"{sum(r.n for r in rows)} changes in {len(rows)} cells"), encoding="utf-8")


def transition_figure(histogram: DataFrame, path: str) -> None:
    """Bars and a matrix of the transitions, at most 49 rows, as PNG: a bar is as long
    as its count's share of the greatest, a cell of the matrix as dark."""
    rows = histogram.orderBy(F.desc("n"), "prev", "mode").collect()
    most = max((r.n for r in rows), default=1)
    canvas = Canvas(1060, max(380, 60 + 16 * len(rows)))
    canvas.text(10, 8, "transitions")
    for i, r in enumerate(rows):
        y, width = 30 + 16 * i, max(1, round(BAR * r.n / most))
        canvas.text(10, y, f"{r.prev}→{r.mode}")
        canvas.rectangle(170, y, width, 12, TYPES.get(f"{r.prev}→{r.mode}", "gray"))
        canvas.text(176 + width, y, str(r.n))
    counts = {(r.prev, r.mode): r.n for r in rows}
    for i, before in enumerate(CANONICAL):
        canvas.text(570, 66 + 30 * i, before)
        canvas.text(650 + 56 * i, 40, before, 1)
        for j, after in enumerate(CANONICAL):
            n = counts.get((before, after), 0)
            x, y, pale = 650 + 56 * j, 56 + 30 * i, round(255 - 185 * n / most)
            canvas.rectangle(x, y, 54, 28, SILVER)
            canvas.rectangle(x + 1, y + 1, 52, 26, (pale, pale, 255))
            canvas.text(x + 6, y + 9, str(n))
    canvas.write(path)


def demographic_figure(splits: DataFrame, path: str) -> None:
    """Stacked shares of travel time by sex, age and diploma, the rows of
    ``modal_splits``, as PNG: BAR pixels are 100 %."""
    groups: dict[str, dict[str, list]] = {}
    for r in splits.orderBy("by", "group", "mode").collect():
        groups.setdefault(r.by, {}).setdefault(r.group, []).append(r)
    canvas = Canvas(1060, 60 + sum(36 + 20 * len(g) for g in groups.values()))
    y = 8
    for title in (t for t in ("sex", "age", "diploma") if t in groups):
        canvas.text(10, y, title, 3)
        y += 22
        for name, rows in groups[title].items():
            canvas.text(10, y + 2, name)
            done = 0.0
            for r in rows:
                x, done = round(BAR * done), done + (r.pct or 0) / 100
                canvas.rectangle(220 + x, y, round(BAR * done) - x, 14, PALETTE.get(r.mode, "gray"))
            y += 20
        y += 14
    for i, (mode, color) in enumerate(PALETTE.items()):
        canvas.rectangle(10 + 130 * i, y, 12, 12, color)
        canvas.text(28 + 130 * i, y + 1, mode)
    canvas.write(path)
