"""Spark-native analytics for nutrient incubation experiments.

Readings -> uptake rates -> response-curve fits -> summaries, plus the
hydrology, snow and chemistry series that accompany them. Every public
function takes and returns ``pyspark.sql.DataFrame`` (or ``Column``).
"""

__version__ = "0.1.0"
