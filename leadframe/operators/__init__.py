"""Operators over pages, content, answers, packages and layouts; each takes and returns DataFrames or Columns."""
