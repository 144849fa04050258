"""Store settings: a key/value table typed on read (A7, J13, S19, SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The store configuration used with the test tables
# (FIXTURES.md §2 v_settings; threshold 200000 so both fee branches occur).
DEFAULT_SETTINGS: list[tuple[str, str, str]] = [
    ("store_name", "Kirana Express", "Display name of the store"),
    ("store_phone", "+10000000000", "Public store phone number"),
    ("delivery_fee", "30.0", "Standard delivery fee"),
    ("free_delivery_threshold", "200000.0", "Order amount for free delivery"),
    ("default_eta_minutes", "40", "Standard delivery ETA in minutes"),
    ("active_language", "kn", "Primary assistant language"),
    ("welcome_greeting", "Namaskara, welcome to {store_name}!", "Spoken greeting template"),
]

SETTINGS_SCHEMA = "key STRING, value STRING, description STRING, updated_at TIMESTAMP"


def settings_frame(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = rows or DEFAULT_SETTINGS
    return spark.createDataFrame([(k, v, d, None) for k, v, d in rows], SETTINGS_SCHEMA)


def settings_row(settings: DataFrame) -> DataFrame:
    """One-row typed pivot of the scalar settings (bounded: one row, fixed columns)."""
    def pick(k: str) -> Column:
        return F.max(F.when(F.col("key") == k, F.col("value")))
    return settings.agg(
        F.coalesce(F.expr("try_cast(" + "max(CASE WHEN key = 'delivery_fee' THEN value END) AS DOUBLE)"),
                   F.lit(30.0)).alias("fee"),
        F.coalesce(F.expr("try_cast(max(CASE WHEN key = 'free_delivery_threshold' THEN value END) AS DOUBLE)"),
                   F.lit(800.0)).alias("threshold"),
        F.coalesce(F.expr("try_cast(max(CASE WHEN key = 'default_eta_minutes' THEN value END) AS INT)"),
                   F.lit(40)).alias("eta_minutes"),
        pick("store_name").alias("store_name"))


def settings_map(settings: DataFrame) -> DataFrame:
    """Settings folded to one map plus a details map of structs."""
    entries = F.sort_array(F.collect_list(F.struct("key", "value")))
    details = F.sort_array(F.collect_list(F.struct("key", F.struct("value", "description", "updated_at"))))
    return settings.agg(F.map_from_entries(entries).alias("settings"),
                        F.map_from_entries(details).alias("details"))


# Fallback defaults when a key is absent from the table.
SETTING_DEFAULTS: dict[str, str] = {
    "store_name": "Kirana Express",
    "store_phone": "+10000000000",
    "delivery_fee": "30.0",
    "free_delivery_threshold": "800.0",
    "default_eta_minutes": "40",
    "active_language": "kn",
}


def setting_value(settings_map_col: Column, key: Column, default: str | None = None) -> Column:
    """Table value, else the defaults map, else ``default`` (only for unknown keys), else ''."""
    defaults = F.create_map(*[x for k, v in SETTING_DEFAULTS.items() for x in (F.lit(k), F.lit(v))])
    k = F.regexp_replace(key, r"^\s+|\s+$", "")
    return F.coalesce(F.element_at(settings_map_col, k),
                      F.element_at(defaults, k),
                      F.lit(default if default is not None else ""))


def upsert_settings(settings: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """SNK3: trim key/value, skip NULL values, last write (by ``seq``) wins,
    refresh ``updated_at``; existing descriptions are kept."""
    now = now if now is not None else F.current_timestamp()
    c = (changes.filter(F.col("value").isNotNull())
         .select(F.regexp_replace("key", r"^\s+|\s+$", "").alias("key"),
                 F.regexp_replace(F.col("value").cast("string"), r"^\s+|\s+$", "").alias("value"),
                 "seq", F.col("ts"))
         .groupBy("key").agg(F.max_by("value", "seq").alias("new_value"), F.max("ts").alias("changed_at")))
    return (settings.join(c, "key", "full_outer")
            .select("key",
                    F.coalesce("new_value", "value").alias("value"),
                    F.coalesce("description", F.lit("")).alias("description"),
                    F.when(F.col("new_value").isNotNull(), F.coalesce("changed_at", now))
                     .otherwise(F.col("updated_at")).alias("updated_at")))
