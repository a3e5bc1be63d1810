"""Readers of dictionary source files, corpora and results, each giving a DataFrame."""
