"""Climatology kept up to date from a stream of samples."""
