"""Rounds that arrive over time: scoring, late labels, keyed folds, monitors."""
