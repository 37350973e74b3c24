"""Spark-native analytics for quantitative fluorescence-microscopy experiments.

``analyze`` runs a whole experiment; the operators package holds the single steps, each
DataFrame in and DataFrame out.
"""

import sys

from pyspark import cloudpickle

from lumenfield.config import configuration
from lumenfield.experiment import analyze, match_fields, measure_fields, save_run, segment_fields, verify_run
from lumenfield.operators.enrichment import adjust, classify
from lumenfield.operators.review import viability_bounds, viability_report
from lumenfield.operators.rollups import count_summary, field_summary, replicate_summary
from lumenfield.sources.manifest import scan_manifest, violations

# Task functions travel to the executors with their helpers, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "adjust", "analyze", "classify", "configuration", "count_summary", "field_summary", "match_fields", "measure_fields",
    "replicate_summary", "save_run", "scan_manifest", "segment_fields", "verify_run", "viability_bounds", "viability_report", "violations",
]
