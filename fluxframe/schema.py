"""Schemas of the library's tables."""

LIGHT_CURVE = "target_id string, mission string, seq bigint, time double, flux double"
CATALOG = "ordinal int, target string, search_name string, kic_id bigint, mission string, known_period_days double, known_depth_ppm double, known_duration_hours double, description string"
SYNTHETIC = "sample_id bigint, noisy array<double>, clean array<double>, label int"
