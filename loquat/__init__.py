"""PySpark-native analytics for source strings, catalogs and assets."""
