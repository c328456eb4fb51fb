"""Where candles come from and are kept."""
