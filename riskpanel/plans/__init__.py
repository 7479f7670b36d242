"""Compositions of operators: feature tables, regime labelling, walk-forward
runs, and the panels derived from the driver's test tables."""
