"""DataFrame operators: contracts, quality, labels, features, folds, metrics, models."""
