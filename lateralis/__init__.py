"""Spark-native analytics of how groups of genes move between genomes."""
