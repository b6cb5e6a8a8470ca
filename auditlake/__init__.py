"""Application-security text forensics as PySpark DataFrame operators."""
