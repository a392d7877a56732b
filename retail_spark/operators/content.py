"""Policies, questions, messages and site settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_list(content: DataFrame, id_column: str) -> DataFrame:
    """Policies or questions in shown order: rows without a place first, then by id."""
    return content.orderBy(F.asc_nulls_first("sort_order"), F.asc(id_column))


def message_list(messages: DataFrame) -> DataFrame:
    return messages.orderBy(F.desc("created_at"), F.desc("message_id"))


def settings_map(settings: DataFrame) -> DataFrame:
    """All settings as one map. Keys are unique and few: the store allows 13."""
    entries = F.collect_list(F.struct("setting_key", "setting_value"))
    return settings.agg(F.map_from_entries(entries).alias("settings"))


def missing_settings(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """The defaults not stored yet; the store saves them at start."""
    return defaults.join(settings.select("setting_key"), "setting_key", "left_anti")


def settings_with_defaults(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    return settings.unionByName(missing_settings(settings, defaults))
