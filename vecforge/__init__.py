"""PySpark-native clustering and nearest-centroid search for dense vectors."""
