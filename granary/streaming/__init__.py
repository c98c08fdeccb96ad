"""The reference has no streaming operators, so there are none here; the DataFrame operators without a global order (axis
tables, ranges by group, masks) also run on streaming DataFrames as far as Structured Streaming allows."""
