"""Dataframe operators: reduction, joins, labels, and the data-processing operators for training data."""
