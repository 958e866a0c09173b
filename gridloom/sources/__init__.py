"""Readers and writers; all go through Spark, so any store that Spark reads will do."""
