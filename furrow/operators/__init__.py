"""Operators over harvests, weather and settings; each takes and returns DataFrames."""
