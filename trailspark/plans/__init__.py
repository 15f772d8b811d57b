"""The reports: whole analyses composed of operators."""
