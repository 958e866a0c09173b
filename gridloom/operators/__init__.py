"""Operators on DataFrames of objects, cells, frames, instances and samples."""
