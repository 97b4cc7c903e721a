"""Liftloom: uplift modelling, covariate matching and policy evaluation on Spark DataFrames."""

__version__ = "0.1.0"
