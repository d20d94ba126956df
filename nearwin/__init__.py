"""nearwin: nearest-neighbour analytics over windows and streams, written for Spark."""
