"""Every threshold of the engine, in one place. Values that the documented
behaviour leaves open are defaults of ours and can be changed here."""

from __future__ import annotations

from dataclasses import dataclass, field

CANONICAL = ("BUS", "CAR", "CYCLING", "SUBWAY", "TRAIN", "TRAMWAY", "WALK")

#: Declared modes and post-processing names -> canonical modes (fixed values).
MODE_MAP = {
    "PRIV_CAR_DRIVER": "CAR",
    "PRIV_CAR_PASSENGER": "CAR",
    "TWO_WHEELER": "CAR",
    "ELECT_SCOOTER": "CAR",
    "TRAIN": "TRAIN",
    "TRAIN_EXPRESS": "TRAIN",
    "SUBWAY": "SUBWAY",
    "TRAMWAY": "TRAMWAY",
    "WALKING": "WALK",
    "BUS": "BUS",
    "BIKE": "CYCLING",
    "ELECT_BIKE": "CYCLING",
}
ALIASES = {"METRO": "SUBWAY", "TAXI": "CAR", **{m: m for m in CANONICAL}}


@dataclass(frozen=True)
class Settings:
    # region, inclusive
    lat: tuple[float, float] = (48.0, 49.3)
    lon: tuple[float, float] = (1.4, 3.6)
    # cleaning
    spike_mps: float = 50.0
    merge_m: float = 10.0
    merge_s: int = 30
    # long traces: a user's points are dealt out by so many microseconds
    block_us: int = 3 * 3600 * 1_000_000
    # trips
    gap_s: int = 600
    stay_m: float = 200.0
    stay_s: int = 1200
    # segments
    walk_mps: float = 1.8
    walk_mps2: float = 0.6
    max_segment_s: int = 600
    short_points: int = 3
    break_rate: float = 0.26
    # optimal breaks: what a part costs, in (mm/s)2, and how many points are searched at once
    break_penalty: int = 60_000_000
    break_points: int = 4096
    # features
    heading_deg: float = 19.0
    stop_mps: float = 3.4
    change_rate: float = 0.26
    fast_kmh: float = 40.0
    very_fast_kmh: float = 58.0
    # training: documented forest
    train_tenths: int = 7
    trees: int = 150
    depth: int = 10
    leaf: int = 5
    sample: float = 0.8
    seed: int = 42
    rows_a_fit_partition: int = 100_000
    # post-processing
    tau: float = 0.6
    vote: int = 5
    unseen: float = 1e-6
    # analysis
    cells_per_degree: int = 1000
    #: bits of a place along each side in the finest level of the pyramid of maps
    tile_bits: int = 12
    radius_m: float = 200.0
    places_per_degree: int = 10_000
    #: places on the rim of the radius are cut into finer x finer parts, so many times
    finer: int = 4
    refined: int = 2
    cluster_cells: int = 2000
    dense: int = 3
    #: clusters can be read at any radius up to this
    reach_m: float = 500.0
    #: neighbours that are sought, and the side of the first cells: quartered up to
    #: nearest_finer times while a cell holds more than nearest_crowd for a query
    nearest: int = 5
    nearest_cell_m: float = 25.0
    nearest_finer: int = 4
    nearest_crowd: int = 8
    ages: tuple[int, ...] = field(default=(18, 30, 45, 60))

    def lat_span_m(self) -> float:
        """The region's greater side, at most."""
        return 111_320.0 * max(self.lat[1] - self.lat[0], self.lon[1] - self.lon[0])


DEFAULTS = Settings()
EARTH_M = 6_371_000
