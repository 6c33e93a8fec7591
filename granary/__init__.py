"""Crop-yield and market-price analytics as Spark DataFrame transforms."""
