"""Default parameters."""

from __future__ import annotations

#: They decide the results.
DEFAULTS = {
    "seed": 1972,
    "scale": 10_000,
    "nodata": -32768,
    "max_gap": 6,
    "otsu_bins": 256,
    "mode_bins": 200,
    "least_values": 1000,
    "in_frames": 12,
    "out_frames": 3,
    "min_observed": 0.30,
    "train_end": 2011,
    "val_end": 2017,
    "resolution_m": 120.0,
    "tile_m": 61_440.0,
    "persons_per_household": 4.5,
    "min_area_km2": 1.0,
    "low_below": 10.0,
    "high_from": 100.0,
    "logit_scale": 8.0,
}
