"""Plan helpers shared by all operators."""
