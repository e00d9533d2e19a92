"""Named queries over the test tables, their SQL oracles, and the full report."""
