"""Inputs: metric points, samples, generators and adapters."""
