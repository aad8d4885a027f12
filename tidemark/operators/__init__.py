"""Operators on ticks, bars, books and series."""
