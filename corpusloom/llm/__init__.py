"""Operators that turn crawled text into training data, and their registered queries."""
