"""Panel, calendar, window, cross-section, inference and portfolio operators."""
