"""Structured Streaming forms of the time-based operators.

Every stream has a watermark; rows later than it are dropped from windowed and
joined results, and idle keys lose their state after a set time.
"""
