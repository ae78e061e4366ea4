"""Predictors: text scoring with a pluggable predictor, boosted trees, joint-embedding network."""
