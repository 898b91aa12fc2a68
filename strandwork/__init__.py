"""Analytics over code graphs as lazy PySpark DataFrame transformations."""
