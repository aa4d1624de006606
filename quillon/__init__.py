"""Spark-first analytics over large media catalogs."""
