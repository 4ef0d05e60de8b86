"""tallyloom: training-data and evaluation-data jobs expressed as Spark DataFrame functions."""
