"""latentlake: sparse latent-feature analytics over tile embeddings, on Spark DataFrames."""

__version__ = "0.1.0"
