"""Operators over DataFrames of prompts and outcomes."""
