"""Query catalogue over the driver's tables, with matching SQL."""
