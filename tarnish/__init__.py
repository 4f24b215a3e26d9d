"""Data-corruption stress testing on Spark."""
