"""Cryptography inventory as Spark jobs."""
