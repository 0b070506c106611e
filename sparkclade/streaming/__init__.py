"""Sampler output as streams."""
