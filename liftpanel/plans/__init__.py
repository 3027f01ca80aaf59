"""Whole analyses: the panel pipeline, its mapping onto the test warehouse and the registered queries."""
