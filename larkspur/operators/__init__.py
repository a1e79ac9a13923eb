"""Statements over tables: reading, joining and writing."""
