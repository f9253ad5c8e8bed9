"""DataFrame operators: features, events, labels, folds, sampling, ranking, models."""
