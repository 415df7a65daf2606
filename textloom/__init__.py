"""Spark-native text analytics: feature operators, rules, models and evaluation as DataFrame plans."""
