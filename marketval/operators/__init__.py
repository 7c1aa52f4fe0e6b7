"""DataFrame -> DataFrame operators. Every key starts with the dataset: market and profile."""
