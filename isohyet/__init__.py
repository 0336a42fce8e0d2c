"""isohyet: Spark-native analytics for station-based environmental observation data."""
