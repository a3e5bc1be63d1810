"""lattica: lattice-based text analysis as Spark DataFrame operators."""
