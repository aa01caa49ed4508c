"""The queries over the data folder and their SQL."""
