"""DataFrame operators: sampling, corruption, cleaning, metrics, schema checks, models."""
