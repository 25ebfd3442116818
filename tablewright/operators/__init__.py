"""DataFrame -> DataFrame operators and fitted models."""
