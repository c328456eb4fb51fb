"""Live candles."""
