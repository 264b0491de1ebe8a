"""Spark-native document triage: validate, fingerprint, read, classify, route and report."""
