"""veridraft: prose-quality analytics as PySpark DataFrame operators."""
