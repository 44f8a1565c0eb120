"""The live feed: as-of views of planned orders and what changed between two of them.

The live feed is a daily batch, so these are batch functions of (row, moment); nothing keeps state
between runs and any two moments can be compared.
"""
