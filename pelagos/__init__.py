"""Spark-first marine climatology: lazy DataFrame transforms over long-form tables."""
