"""Lodestone: content identification and corpus preparation as Spark DataFrame programs."""
