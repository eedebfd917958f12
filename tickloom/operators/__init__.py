"""The reference work as DataFrame operators: each takes and returns DataFrames, lazily."""
