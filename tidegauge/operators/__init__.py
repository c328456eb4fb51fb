"""Operators on candle frames."""
