"""Graph, vector and corpus analytics as PySpark DataFrame transformations."""
