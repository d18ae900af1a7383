"""Operators over the silver event table: each takes and returns DataFrames, lazily."""
