"""Explicit schemas of the stored tables and their keys."""

from __future__ import annotations

FIELDS = "id int, name string"
DAILY_PLAN = "plan_date date, field_id int, position int"
PLAN_DAYS = "plan_date date, initialized boolean, created_at timestamp"
HARVESTS = "harvest_date date, field_id int, interval_days int, a decimal(12,2), b decimal(12,2), c decimal(12,2), xl decimal(12,2), created_at timestamp, updated_at timestamp"
WEATHER_DAILY = (
    "weather_date date, source_station string, temp_avg_c decimal(6,2), temp_min_c decimal(6,2), temp_max_c decimal(6,2), "
    "humidity_avg_pct decimal(6,2), humidity_min_pct decimal(6,2), humidity_max_pct decimal(6,2), precipitation_mm decimal(10,2), "
    "wind_avg_ms decimal(7,2), wind_max_ms decimal(7,2), wind_gust_ms decimal(7,2), wind_direction_deg decimal(6,2), "
    "pressure_avg_hpa decimal(8,2), dewpoint_avg_c decimal(6,2), sunshine_hours decimal(6,2), radiation_mj_m2 decimal(10,2), "
    "radiation_station string, notes string, created_at timestamp, updated_at timestamp, data_kind string, forecast_source string, "
    "checked boolean, check_message string"
)
APP_SETTINGS = "key string, value string, updated_at timestamp"
READINGS = "station string, year int, month int, day int, hour int, value string, element string"

KEYS = {"fields": ["id"], "daily_plan": ["plan_date", "field_id"], "plan_days": ["plan_date"], "harvests": ["harvest_date", "field_id"], "weather_daily": ["weather_date"], "app_settings": ["key"]}
#: What a new row gets in columns that a write leaves out.
DEFAULTS = {"harvests": {"a": 0, "b": 0, "c": 0, "xl": 0}, "plan_days": {"initialized": True}, "weather_daily": {"data_kind": "measured", "checked": False, "source_station": "main", "radiation_station": "coast"}}
