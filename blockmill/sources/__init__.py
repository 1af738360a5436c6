"""Reading and writing block data sets."""
