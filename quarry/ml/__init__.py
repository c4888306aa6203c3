"""Models in SQL, on ``pyspark.ml``; any object with ``fit`` and ``predict`` works too."""
