"""Relational operators: plain functions from DataFrame to DataFrame."""
