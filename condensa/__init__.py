"""Bounded extractive projection of text, and the tables around it, as Spark plans."""
