"""Geometry on the sphere in numpy: what runs inside Arrow UDFs."""
