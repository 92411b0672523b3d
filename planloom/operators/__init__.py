"""Operators over DataFrames: joins, roll-ups, windows, retrieval, graphs, replay."""
