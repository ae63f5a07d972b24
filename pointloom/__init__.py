"""pointloom: labelled 3-D points and their features as Spark tables."""
