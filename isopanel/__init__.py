"""Distances, sparse graphs, geometry and their statistics on Spark."""
