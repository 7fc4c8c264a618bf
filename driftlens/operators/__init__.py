"""Operators over plain tables; each takes and gives DataFrames and collects nothing."""
