"""Personal-data detection, masking and audit over tables of text units, on Spark."""
