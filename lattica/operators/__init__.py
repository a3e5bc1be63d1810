"""Lattice, dictionary, evaluation and training operators."""
