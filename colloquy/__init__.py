"""colloquy: conversation analytics on PySpark DataFrames.

Everything is declared with the DataFrame/SQL API; Python runs only where no
built-in expression can say it, and then in Arrow batches.
"""

__version__ = "0.1.0"
