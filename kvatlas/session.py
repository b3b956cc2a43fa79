"""A session with the settings that the engine counts on."""

from pyspark.sql import SparkSession

#: UTC timestamps; runtime re-planning; later keys win when maps are merged (alias overlays, rule edits).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(app: str = "kvatlas", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()
