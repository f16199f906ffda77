"""The query catalogue over the driver's tables, and the same answers as SQL."""
