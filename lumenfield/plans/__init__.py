"""All registered plans; importing this package fills the registry."""

from lumenfield.plans import background, inputs, matching, objects, raster, regions, review, runs, streams, sweeps, volume  # noqa: F401
from lumenfield.plans.registry import ORACLES, QUERIES  # noqa: F401
