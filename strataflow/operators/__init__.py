"""Operators over DataFrames: post-processing, lookups, spatial imputation, alignment, folds, models."""
