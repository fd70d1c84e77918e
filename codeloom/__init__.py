"""Code graphs and corpus jobs as PySpark DataFrame operators."""
