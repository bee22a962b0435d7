"""Lodestone: similarity retrieval and corpus preparation on PySpark."""
