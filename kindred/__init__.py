"""Similarity digests of binary and text objects, computed and compared with Spark."""
