"""Analytics over object-detection sightings, written as PySpark DataFrame operators."""
