"""Wayfarer: text, place and corpus analytics written as Spark DataFrame programs."""
