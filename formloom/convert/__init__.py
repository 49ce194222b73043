"""Conversion of foreign form formats to survey, choices and settings rows with a report."""
