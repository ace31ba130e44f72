"""Conditions on catalogued files, stated once for the catalog's own SQL and for DataFrames.

Each is SQL text with named places; the catalog puts parameters there, a DataFrame filter puts literals.
"""

OVERLAPS = "state = 'active' AND max_ts >= {time_from} AND min_ts <= {time_to}"
TIER_ELIGIBLE = "state = 'active' AND tier = 'hot' AND max_ts < {cutoff}"
EXPIRED = "state = 'active' AND ((tier = 'hot' AND max_ts < {hot}) OR (tier = 'cold' AND max_ts < {cold}))"
PAST_GRACE = "state = 'superseded' AND superseded_at > 0 AND superseded_at < {cutoff}"
BUCKET = "state = 'active' AND tier = 'hot' AND service = {service} AND time_bucket = {time_bucket}"
COMPACTABLE = "{count} >= {least}"
