"""Whole plans assembled from the operators."""
