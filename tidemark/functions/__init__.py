"""Column helpers, distributed ranking and autocorrelation-robust errors."""
