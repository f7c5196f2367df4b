"""Tessera: customer intelligence and corpus preparation on PySpark."""
