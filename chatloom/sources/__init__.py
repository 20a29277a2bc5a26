"""Readers, writers and the derivations that turn the driver tables into operator inputs."""
