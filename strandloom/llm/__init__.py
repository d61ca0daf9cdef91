"""Training-data operators. Nothing else in strandloom imports this subpackage."""
