"""Composed runs: general tests, findings, chart selection, full analysis."""
