"""Distributed operators, DataFrame in and DataFrame out."""
