"""Spark jobs for finding, expanding and tabulating the files inside captured HTTP responses."""
