"""Evaluation of predictive models against labelled datasets, on Spark DataFrames."""
