"""Query catalogue: operators bound to the driver's tables."""
