"""Pair analytics and corpus preparation as lazy Spark DataFrame transformations."""
