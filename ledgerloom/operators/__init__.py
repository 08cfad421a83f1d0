"""Ledger operators: functions from DataFrames to DataFrames, for all users at once."""
