"""Relational operators: features, counts, models, scores, splits, evaluation."""
