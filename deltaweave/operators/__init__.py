"""Operators over relations."""

from .aggregates import consolidate, counts, distinct, global_max, global_min, maxes, mins, random_ns, top_ns, unconsolidate
from .joins import antijoin, cartesian_product, join, join_values, semijoin
from .projection import filter, flat_map, flat_map_h, flatten, flatten_h, fsts, map, map_h, partition, snds, split, swaps
from .setops import concat, intersection, set_minus
from .sharing import Save, dynamic, save, shared

__all__ = [
    "Save", "antijoin", "cartesian_product", "concat", "consolidate", "counts", "distinct", "dynamic", "filter", "flat_map", "flat_map_h", "flatten", "flatten_h", "fsts", "global_max", "global_min",
    "intersection", "join", "join_values", "map", "map_h", "maxes", "mins", "partition", "random_ns", "save", "semijoin", "set_minus", "shared", "snds", "split", "swaps", "top_ns", "unconsolidate",
]
