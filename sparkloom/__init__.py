"""Sparkloom: declarative call plans compiled to lazy Spark DataFrames."""
