"""Column -> Column helpers; everything here stays inside JVM expressions."""

from .keys import (
    month_bucket, normalize_location, order_event_key, sanitize_topic, short_type_name, sku_location_key, uuid_v5,
    weekday_index, weekday_name,
)
from .numeric import clamp, exact_mean, trunc_int
from .folds import decayed_stat, let, recent_rate_step
from .texts import strict_json
from .vectors import cosine_distance

__all__ = [
    "month_bucket", "normalize_location", "order_event_key", "sanitize_topic", "short_type_name", "sku_location_key",
    "uuid_v5", "weekday_index", "weekday_name", "clamp", "exact_mean",
    "trunc_int", "decayed_stat", "let", "recent_rate_step", "strict_json", "cosine_distance",
]
