"""Operators on catalog tables: reference data, upserts, history, logs, analytics, reads."""
