"""Default controls of a planar run."""

from __future__ import annotations

from copy import deepcopy

# fixed values: the calibrated default configuration
DEFAULTS = {
    "input": {"dtype_max": 255, "shape": (1024, 1024), "pixel_size_um": (2.272724609375, 2.272724609375)},
    "segmentation": {
        "background_sigma_px": 12.0,
        "green": {"sigma_px": 1.2, "high": 10.0, "low": 5.0, "min_area_px": 20},
        "red": {"sigma_px": 1.0, "high": 4.0, "low": 2.0, "min_area_px": 12},
        "peak_window_px": 7, "min_peak_distance_px": 6.0, "exclude_border": True,
    },
    "matching": {"max_distance_px": 6.0, "dilation_px": 1, "overlap_window_radius_px": 24},
    "ebfp": {
        "roi_dilation_px": 1, "occupied_dilation_px": 2, "null_inner_px": 18, "null_outer_px": 65,
        "q_threshold": 0.05, "min_null_locations": 100, "comparison_tolerance": 1e-5,
    },
    "sensitivity": {
        "segmentation_factors": [0.75, 1.0, 1.25], "ebfp_q_thresholds": [0.01, 0.025, 0.05, 0.1],
        "ebfp_dilation_px": [0, 1, 2], "spatial_null_shift_px": (35, 35),
    },
    "display": {"green": (0, 120), "red": (0, 30), "ebfp": (0, 34), "central_crop_fraction": 0.375},
}


def configuration(**sections) -> dict:
    """The defaults with some values replaced: ``configuration(matching={"dilation_px": 0})``."""
    config = deepcopy(DEFAULTS)
    for name, values in sections.items():
        for key, value in values.items():
            if isinstance(value, dict):
                config[name][key] = {**config[name].get(key, {}), **value}
            else:
                config[name][key] = value
    return config
