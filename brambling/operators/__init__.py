"""Relational operators of knowledge bases and event logs, as functions of DataFrames."""
