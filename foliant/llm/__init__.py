"""Training-data operators. Nothing outside this package imports it; remove the folder and the rest still works."""
