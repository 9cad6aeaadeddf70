"""verbaloom: a PySpark engine for corpus-scale construction mining."""

__version__ = "0.1.0"
