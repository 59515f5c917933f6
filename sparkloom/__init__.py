"""sparkloom: declarative query documents, models, vectors, graphs and text on PySpark."""

__version__ = "0.1.0"
