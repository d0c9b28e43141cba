"""Transforms of long-form tables: roll-ups, distributions, spatial lookups, polylines, rasters."""
