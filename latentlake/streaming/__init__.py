"""Incremental maintenance of latent statistics."""
