"""Analytics over earthquake-event catalogs as Spark DataFrame operators."""
